"""Licence scan by ordered signature rules.

A text is read as its words (runs of characters other than ASCII marks and control characters, A-Z in lower case). Each rule of
``license_rules`` is tried only in texts that have the words it needs: one look-up of a text's words names the rules whose
rarest word it has, most texts end there. What rules find are intervals of words. An interval that lies
within one of a better priority, or within a longer one (or an equal one of an earlier rule) of its own
priority, is suppressed; the others give the labels. The base phrases are always reported, nothing suppresses them.

The score is the noisy or of the labels' weights: 1 - product of (1 - weight), 0 without a label.

Defined results: a NULL or empty text has no words, no labels (``''``), NULL places and score 0; texts are scanned whole, at any length; rows
are independent of each other, so repeated rows and ids give a row each; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import small_batches
from tessera.llm.license_rules import BASE, BASE_WEIGHT, Rule, all_rules

#: Bytes of words stay, A-Z become a-z, all others are spaces.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

DETECTION = "struct<label: string, weight: double, priority: int, first: bigint, last: bigint, kept: boolean>"
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
_TYPES = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def kept(priority: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which intervals nothing suppresses; they come in the order of their rules.

    Level by level: the intervals of better levels, sorted by start with the furthest end so far, tell by one search whether
    they hold an interval; within a level the same holds for those that come before it by (start, longest, rule)."""
    out = np.ones(len(first), bool)
    better_first, better_last = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for p in np.unique(priority):
        at = np.flatnonzero(priority == p)
        at = at[np.lexsort((at, -last[at], first[at]))]
        a, b = first[at], last[at]
        reach = np.maximum.accumulate(b)
        held = np.append(False, reach[:-1] >= b[1:])
        if len(better_first):
            k = np.searchsorted(better_first, a, "right") - 1
            held |= (k >= 0) & (better_last[k] >= b)
        out[at] = ~held
        both_first, both_last = np.append(better_first, a), np.append(better_last, b)
        order = np.argsort(both_first, kind="stable")
        better_first, better_last = both_first[order], np.maximum.accumulate(both_last[order])
    return out


class Scanner:
    """The rules with their prefilter."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = all_rules() if rules is None else rules
        self.base = [(label, re.compile(b"(?<= )" + phrase.encode() + b"(?= )"), frozenset(phrase.encode().split())) for phrase, label in BASE.items()]
        self.by_word: dict[bytes, list[int]] = defaultdict(list)
        for i, r in enumerate(self.rules):
            self.by_word[max(r.needs, key=lambda w: (len(w), w))].append(i)
        self.words = frozenset(self.by_word).union(*(needs for _, _, needs in self.base))

    def scan(self, text: bytes) -> tuple:
        """The columns of _NAMES for one text."""
        words = text.translate(WORD_BYTES).split()
        hints = self.words.intersection(words)
        if not hints:
            return len(words), 0, None, None, "", "", 0.0, []
        have = set(words)
        line = b" " + b" ".join(words) + b" "
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        weights: dict[str, float] = {}
        places = []
        for label, pattern, needs in self.base:
            if needs <= have:
                starts = [m.start() - 1 for m in pattern.finditer(line)]
                if starts:
                    places += np.searchsorted(spaces, starts).tolist()
                    weights[label] = BASE_WEIGHT
        base = ",".join(sorted(weights))
        found = []
        for i in sorted(i for w in hints for i in self.by_word.get(w, ())):
            r = self.rules[i]
            if r.needs <= have:
                found += [(i, m.start() - 1, m.end()) for m in r.pattern.finditer(line)]
        if found:
            rule, start, end = (np.array(c, np.int64) for c in zip(*found, strict=True))
            first, last = np.searchsorted(spaces, start), np.searchsorted(spaces, end) - 1
            stays = kept(np.array([self.rules[i].priority for i in rule]), first, last)
            found = [(self.rules[i].label, self.rules[i].weight, self.rules[i].priority, a, b, k)
                     for i, a, b, k in zip(rule.tolist(), first.tolist(), last.tolist(), stays.tolist(), strict=True)]
            for label, weight, _, _, _, k in found:
                if k:
                    weights[label] = max(weight, weights.get(label, 0.0))
        none = 1.0
        for label in sorted(weights):
            none *= 1.0 - weights[label]
        return (len(words), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(weights)),
                round(1.0 - none, 12), found)


_SCANNERS: list[Scanner] = []


def scanner() -> Scanner:
    """The worker's scanner, made once."""
    if not _SCANNERS:
        _SCANNERS.append(Scanner())
    return _SCANNERS[0]


def scan_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its key, the numbers of the base phrases, labels, score and all detections with their intervals of words."""
    rows = small_batches(df).select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    detections = pa.list_(pa.struct([("label", pa.string()), ("weight", pa.float64()), ("priority", pa.int32()), ("first", pa.int64()),
                                     ("last", pa.int64()), ("kept", pa.bool_())]))
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), detections]

    def run(batches):
        tool = scanner()
        names = [f.name for f in detections.value_type]
        for b in batches:
            found = [tool.scan(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            columns = [list(c) for c in zip(*found, strict=True)] or [[] for _ in types]
            columns[-1] = [[dict(zip(names, d, strict=True)) for d in row] for row in columns[-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, *_NAMES])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {_TYPES}, detections array<{DETECTION}>")
