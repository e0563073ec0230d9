"""PII surrogates: detected entities get keyed replacements of their own kind.

Only DataFrame functions are used. One pattern finds e-mail and IP addresses (versions 4 and 6),
phone numbers (with a country code, an area code in brackets, or as nationally written), card numbers that pass the Luhn test, US social security
numbers, IBANs, secrets (long random words, issued keys by their prefix, values called a password, key or token), and person names after a title.
An entity is the canonical form of a match (a phone number's digits, a
lower-case address, one word of a name), so all spellings of one entity share
one surrogate; the spelling's format is filled in again afterwards:

* letters become letters of the same script and case, digits digits, hexadecimal
  secrets stay hexadecimal, IP addresses stay valid, card numbers keep their
  first two digits and pass the Luhn test again, IBAN country codes, prefixes of issued keys and e-mail top-level domains stay, and so do capitals;
* given names get the grammatical gender of their title and the script of the original; after a title without gender they
  share the surrogate they have after one with a gender, if there is one in the table;
* a name's words are replaced wherever they stand capitalised in a text that has them after a title; possessives and particles
  (``van der``) stay, and so do common words (COMMON) that begin a sentence.

The surrogate is a function of (key, kind, entity, attempt). Collisions are checked over all
entities of the table: a surrogate that is a real entity of its kind, or that two entities
share, is drawn again with the next attempt for all but one of them, until none is left; so distinct
entities stay distinct, and one entity has one surrogate in every document. Made names grow with every attempt, and
phone numbers, addresses and secrets from the third redraw on, so that short forms never run out; a name in a
script without syllables gets a Latin one.
Replacement is a pure column expression for first attempts. Entities that
needed another attempt are joined by text, and only if there are any.

Defined results: NULL texts stay NULL and empty texts empty; texts without
entities are returned unchanged; repeated rows are treated alike; an empty table gives an empty result; extra
columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch_dir

#: Titles that make the capitalised words after them a person's name, by gender.
TITLES = {
    "f": ("Mrs.", "Ms.", "Mrs", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Госпожа", "Κυρία"),
    "m": ("Mr.", "Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr.", "Господин", "Κύριος"),
    "u": ("Dr.", "Prof."),
}
#: Consonants and vowels of made names' syllables, by script; endings by gender, "s" for surnames.
LETTERS = {"latin": ("bdfgklmnprstvwz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστφ", "αειου")}
SYLLABLES = {script: tuple(c + v for c in consonants for v in vowels) for script, (consonants, vowels) in LETTERS.items()}
#: Syllables of a first draw: tens of millions of names, so few entities are drawn again.
FIRST_SYLLABLES = 4
ENDINGS = {
    "latin": {"f": "na", "m": "ro", "u": "lin", "s": "man"},
    "cyrillic": {"f": "на", "m": "ор", "u": "ли", "s": "ман"},
    "greek": {"f": "να", "m": "ρος", "u": "λι", "s": "μαν"},
}
_TITLE = "|".join(t.replace(".", "\\.") for g in TITLES.values() for t in g)
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
SECRET = r"(?<![\p{L}\p{N}_-])(?=[\p{L}_-]{0,64}\d)(?=[\d_-]{0,64}\p{L})[A-Za-z0-9_-]{32,}+(?![\p{L}\p{N}])"
#: A value that a text itself calls a password, key or token; it has a digit, and is no e-mail address.
_CALLED = r"""(?i:\b(?:password|passwd|pwd|passphrase|secret|api[_-]?key|access[_-]?key|auth[_-]?token|token))["']?\s{0,2}[:=]\s{0,2}["']?"""
ASSIGNED = _CALLED + r"""(?![^\s@]{1,64}+@[^\s@]{1,64}\.\p{L})(?=[^\s"',;<>]{0,64}\d)[^\s"',;<>]{4,128}"""
#: How issued keys begin.
_PREFIX = "AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza"
ISSUED = rf"(?<![\p{{L}}\p{{N}}_-])(?:(?:AKIA|ASIA)[A-Z0-9]{{16}}|(?:gh[pousr]_|sk-|xox[abprs]-|AIza)(?=[A-Za-z_-]{{0,64}}\d)[A-Za-z0-9_-]{{10,}})(?![\p{{L}}\p{{N}}])"
IP = r"(?<![\p{L}\d.])(?<![Vv]ersion )(?<![Rr]elease )(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]{{0,30}}\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::{_HEX}(?::{_HEX}){{0,6}}|(?:{_HEX}:){{2,7}}:)(?![\p{{L}}\p{{N}}:])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: Digits that begin as issuers' numbers do; only those that pass the Luhn test are cards.
CARD = r"(?<![\d.,-])(?=3[ -]?[04-8]|4|5[ -]?[0-9]|6|2[ -]?[2-7])\d(?:[ -]?\d){12,18}(?![\d])"
PHONE = (r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .-]?)?\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\d)|(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
         r"|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\p{L}\p{N}.,+-])(?<!\d )\d{3} \d{3} \d{4}(?![\p{L}\p{N}])(?! \d)"
         r"|(?<![\p{L}\p{N}.,+-])(?<!\d )0[1-9]\d{1,3}[ /-]\d{5,8}(?![\p{L}\p{N}])(?! \d)")
#: A capitalised word that is no title before another capitalised word; all such words after a title, and initials between them, are the name.
_CAPITAL = rf"(?!(?:{_TITLE}) \p{{Lu}})\p{{Lu}}[\p{{L}}'’-]{{1,40}}"
_NAME_WORD = rf"(?:\p{{Lu}}\. )*+{_CAPITAL}"
#: Small words inside names; they stay as they are.
PARTICLES = "van von vom der den de del della di da dos das du la le ten ter zu zur zum bin ibn al el af av".split()
_PARTICLE = "|".join(PARTICLES)
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE}) {_NAME_WORD}(?:(?: (?:{_PARTICLE}))*+ {_NAME_WORD})*"
#: Words that begin sentences as often as they are names; at the start of a sentence they name nobody.
COMMON = ("will may mark grant hope bill rich art sue pat rob drew chase faith grace joy april june august summer autumn rose dawn miles frank jack "
          "young long short black white brown green gray grey wood stone hill rice bell cook baker page price best small strong sharp early day love").split()
#: What stands before a word that begins a sentence.
_BEGINS = r"(?:^|[.!?:][\"'”’»)]*\s+|[\r\n]\s*)[\"'“‘«(]*$"
#: What follows a name in its word: a possessive, hyphens and apostrophes.
_TAIL = r"(?:['’][sS])?[-'’]*$"
_MENTION = r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}'’-]{1,40}"
ANY = "|".join((EMAIL, IBAN, ASSIGNED, SECRET, ISSUED, IP, IP6, SSN, CARD, PHONE, NAME))

#: What every entity holds at least; tested first, since most texts hold none of it.
HINT = "[0-9@]|(?=[" + "".join(sorted({t[0] for g in TITLES.values() for t in g})) + f"])(?:{_TITLE}) "

_LOWER = {"a": "abcdefghijklmnopqrstuvwxyz", "é": "áàâäãåæçéèêëíìîïñóòôöõøœúùûüýÿß",
          "я": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "ω": "αβγδεζηθικλμνξοπρστυφχψω"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of(m: Column) -> Column:
    """What a match is; "none" for digits that look like a card number and are none."""
    tests = (("name", rf"^(?:{_TITLE}) \p{{Lu}}"), ("secret", "^" + _CALLED), ("email", "@"), ("ip", r"^\d{1,3}(\.\d{1,3}){3}$"),
             ("ip6", "^[0-9A-Fa-f]*:[0-9A-Fa-f:]+$"), ("ssn", r"^\d{3}-\d{2}-\d{4}$"), ("iban", r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"))
    out = reduce(lambda out, t: out.when(m.rlike(t[1]), t[0]), tests[1:], F.when(m.rlike(tests[0][1]), tests[0][0]))
    digits = F.regexp_replace(m, r"\D", "")
    card = F.when(F.pmod(_luhn(digits), F.lit(10)) == 0, "card").otherwise("none")
    return out.when(m.rlike(r"^[2-6](?:[ -]?\d){12,18}$"), card).when(m.rlike(r"\p{L}"), "secret").otherwise("phone")


def _gender(m: Column) -> Column:
    def of(g):
        return m.rlike("^(?:" + "|".join(t.replace(".", "\\.") for t in TITLES[g]) + ") ")
    return F.when(of("f"), "f").when(of("m"), "m").otherwise("u")


def _title(m: Column) -> Column:
    return F.regexp_extract(m, rf"^((?:{_TITLE}) )", 1)


def _called(m: Column) -> Column:
    """What stands before the value of an assignment; "" for other matches."""
    return F.regexp_extract(m, "^(" + _CALLED + ")", 1)


def _particle(word: Column) -> Column:
    return word.isin(*PARTICLES)


def _tail(word: Column) -> Column:
    return F.regexp_extract(word, _TAIL, 0)


def _bare(word: Column) -> Column:
    """A word of a name without its possessive."""
    return F.substring(word, F.lit(1), F.length(word) - F.length(_tail(word)))


def _cased(word: Column, new: Column) -> Column:
    """A made name in the case of a word, with its possessive; of an initial, the initial."""
    first, bare = F.upper(F.substring(new, 1, 1)), _bare(word)
    name = F.when((F.length(bare) > 1) & (bare == F.upper(bare)), F.upper(new)).otherwise(F.concat(first, F.substring(new, F.lit(2), F.length(new))))
    return F.when(word.rlike(r"^\p{Lu}\.$"), F.concat(first, F.lit("."))).otherwise(F.concat(name, _tail(word)))


def _names(found: Column) -> Column:
    """The distinct names among entities, surnames before given names; initials name nobody."""
    names = F.filter(found, lambda e: ((e["kind"] == "surname") | e["kind"].startswith("given")) & ~e["entity"].endswith("."))
    ranked = F.concat(F.filter(names, lambda e: e["kind"] == "surname"), F.filter(names, lambda e: e["kind"] != "surname"))
    return _let(ranked, lambda r: _let(F.transform(r, lambda e: e["entity"]), lambda words: F.filter(
        r, lambda e, i: F.array_position(words, e["entity"]) == i + 1)))


def _mentions(gap: Column, known: Column) -> Column:
    """The text between matches with every capitalised word that is a known name replaced; common words only inside a sentence."""
    def say(before: Column, w: Column) -> Column:
        name = _let(F.try_element_at(known, F.lower(_bare(w))), lambda new: F.when(new.isNull(), w).otherwise(_cased(w, new)))
        return F.when(F.lower(_bare(w)).isin(*COMMON) & before.rlike(_BEGINS), w).otherwise(name)
    return F.concat_ws("", F.zip_with(F.split(gap, _MENTION, -1), F.regexp_extract_all(gap, F.lit(_MENTION), F.lit(0)),
                                      lambda g, w: F.concat(g, F.when(w.isNull(), "").otherwise(say(g, w)))))


def entities(m: Column) -> Column:
    """The entities of a match: an array of (kind, entity)."""
    def one(kind, e):
        return F.struct(kind.alias("kind"), e.alias("entity"))
    return _let(kind_of(m), lambda kind: _entities(m, kind, one))


def _entities(m: Column, kind: Column, one: Callable[[Column, Column], Column]) -> Column:
    words = F.split(F.substring(m, F.length(_title(m)) + 1, F.length(m)), " ")
    names = F.transform(words, lambda w, i: one(F.when(_particle(w), "particle").when(i < F.size(words) - 1, F.concat(F.lit("given_"), _gender(m)))
                                                .otherwise("surname"), F.lower(_bare(w))))
    plain = (F.when(kind.isin("email", "ip6"), F.lower(m)).when(kind.isin("phone", "card", "ssn"), F.regexp_replace(m, r"\D", ""))
             .when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
             .when(kind == "secret", F.substring(m, F.length(_called(m)) + 1, F.length(m))).otherwise(m))
    found = F.when(kind == "name", names).otherwise(F.array(one(kind, plain)))
    return F.when(kind == "none", F.slice(found, 1, 0)).otherwise(found)


def _draws(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """256 hexadecimal digits that depend on the key and the entity."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, entity, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"\u0001{i}")), 256) for i in range(4)])


def _number(draws: Column, i: Column, below: int) -> Column:
    """The i-th number below a bound, from four hexadecimal digits (64 of them, then again)."""
    return F.pmod(F.conv(F.substring(draws, F.pmod(i, F.lit(64)) * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(below))


def _alike(text: Column, draws: Column) -> Column:
    """Each letter or digit replaced by one of its script and case."""
    def swap(c: Column, i: Column) -> Column:
        return _let(F.lower(c), lambda low: lettered(c, low, i))

    def lettered(c: Column, low: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), _number(draws, i, 10).cast("string"))
        for letters in _LOWER.values():
            new = F.substring(F.lit(letters), _number(draws, i, len(letters)) + 1, F.lit(1))
            out = out.when(low.rlike(f"[{letters}]"), F.when(c == low, new).otherwise(F.upper(new)))
        for lo, hi in ((0x4E00, 0x9FA5), (0x3041, 0x3093), (0x30A1, 0x30F3), (0xAC00, 0xD7A3)):
            new = F.decode(F.unhex(F.lpad(F.hex(_number(draws, i, hi - lo + 1) + lo), 4, "0")), "UTF-16BE")
            out = out.when(c.rlike(f"[{chr(lo)}-{chr(hi)}]"), new)
        return out.otherwise(c)
    return F.concat_ws("", F.transform(F.split(text, ""), swap))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, rightmost digit not doubled."""
    def add(total, c, i):
        d = c.cast("int") * (1 + F.pmod(i, F.lit(2)))
        return total + F.when(d > 9, d - 9).otherwise(d)
    marked = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(marked, F.lit(0), lambda t, x: add(t, x["c"], x["i"]))


def surrogate(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """The canonical surrogate of an entity at an attempt."""
    return _let(_draws(key, kind, entity, attempt), lambda draws: _surrogate(kind, entity, attempt, draws))


def _surrogate(kind: Column, entity: Column, attempt: Column, draws: Column) -> Column:
    n = F.length(entity)
    digits = F.concat_ws("", F.transform(F.sequence(F.lit(0), n - 1), lambda i: _number(draws, i, 10).cast("string")))
    # a card stays one of its issuers
    card = F.concat(F.substring(entity, 1, 2), F.substring(digits, F.lit(3), n - 3))
    body = F.concat(card, F.lit("0"))
    luhn = F.concat(card, F.pmod(F.lit(10) - F.pmod(_luhn(body), F.lit(10)), F.lit(10)).cast("string"))
    ip = F.concat_ws(".", *[(_number(draws, F.lit(i), 254) + 1).cast("string") for i in range(4)])
    top = F.regexp_extract(entity, r"(\.\p{L}+)$", 1)
    email = F.concat(_alike(F.substring(entity, F.lit(1), n - F.length(top)), draws), top)
    script = F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").when(entity.rlike(r"\p{IsGreek}"), "greek")
    name = None
    for s, syllables in SYLLABLES.items():
        def one(i, syllables=syllables):
            return F.element_at(F.array(*map(F.lit, syllables)), _number(draws, i, len(syllables)) + 1)
        # every later attempt draws a syllable more, so there is always room
        stem = F.concat(*[one(F.lit(i)) for i in range(FIRST_SYLLABLES)], F.when(attempt > 0, F.concat_ws("", F.transform(
            F.sequence(F.lit(FIRST_SYLLABLES), attempt + (FIRST_SYLLABLES - 1)), lambda i: one(i)))).otherwise(""))
        end = reduce(lambda o, g, s=s: o.when(kind == f"given_{g}", ENDINGS[s][g]), "fmu", F.when(kind == "surname", ENDINGS[s]["s"]))
        # other scripts have no syllables here, and keeping their letters would keep the name
        name = F.concat(stem, end) if name is None else F.when(script == s, F.concat(stem, end)).otherwise(name)
    # from the third redraw on, what may be too short for all its entities grows by a character an attempt
    grows = attempt > 2
    more = F.sequence(F.lit(3), attempt)
    more_digits = F.when(grows, F.concat_ws("", F.transform(more, lambda i: _number(draws, i + 32, 10).cast("string")))).otherwise("")
    more_letters = F.when(grows, F.concat_ws("", F.transform(more, lambda i: F.substring(F.lit(_LOWER["a"]), _number(draws, i + 32, 26) + 1, F.lit(1))))).otherwise("")
    hexed = F.concat_ws("", F.transform(F.split(entity, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(draws, i + 1, F.lit(1)))))
    prefix = F.regexp_extract(entity, f"^({_PREFIX})", 1)
    issued = F.concat(prefix, _alike(F.substring(entity, F.length(prefix) + 1, n), draws), more_letters)
    return (F.when(kind == "particle", entity).when(kind == "email", F.concat(more_letters, email)).when(kind == "ip", ip).when(kind == "ip6", hexed)
            .when(kind == "card", luhn).when(kind == "phone", F.concat(digits, more_digits)).when(kind == "ssn", digits)
            .when(kind == "iban", F.concat(F.substring(entity, 1, 2), _alike(F.substring(entity, F.lit(3), n), draws)))
            .when((kind == "secret") & entity.rlike("^[0-9a-f]+$"), F.substring(F.concat(draws, draws, draws), F.lit(1), n))
            .when(kind.startswith("given") | (kind == "surname"), name).otherwise(issued))


def rendered(m: Column, new: Column) -> Column:
    """A match written with its entities' surrogates, in its own format."""
    return _let(kind_of(m), lambda kind: _let(new, lambda n: _rendered(m, kind, n, F.try_element_at(n, F.lit(1)))))


def _rendered(m: Column, kind: Column, new: Column, first: Column) -> Column:
    def fill(s: Column) -> Column:
        start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
        def step(a, c):
            own = c.rlike("[0-9A-Za-z]")
            return F.struct(F.concat(a["s"], F.when(own, F.substring(s, a["i"], F.lit(1))).otherwise(c)).alias("s"),
                            (a["i"] + own.cast("int")).alias("i"))
        # characters beyond the format's places (short numbers drawn again) follow at its end
        return F.aggregate(F.split(m, ""), start, step, lambda a: F.concat(a["s"], F.substring(s, a["i"], F.length(s))))

    def capitals(s: Column) -> Column:
        """A character is a capital where the one at its place in the match is; what a redraw put before has none."""
        extra = F.length(s) - F.length(m)
        return F.concat_ws("", F.transform(F.split(s, ""), lambda c, i: _let(
            F.substring(m, i + 1 - extra, F.lit(1)), lambda own: F.when((i >= extra) & (own != F.lower(own)), F.upper(c)).otherwise(c))))

    words = F.split(F.substring(m, F.length(_title(m)) + 1, F.length(m)), " ")
    cased = F.zip_with(words, new, lambda w, n: F.when(_particle(w), w).otherwise(_cased(w, n)))
    return (F.when(kind == "none", m).when(kind == "name", F.concat(_title(m), F.concat_ws(" ", cased)))
            .when(kind.isin("phone", "card", "ssn", "iban"), fill(first))
            .when(kind == "secret", F.concat(_called(m), first))
            .when(kind.isin("email", "ip6"), capitals(first)).otherwise(first))


def _shared_given(found: DataFrame) -> DataFrame:
    """``entity, as_kind`` of given names after a title without gender that stand after one with a gender elsewhere (the more frequent)."""
    known = found.where("kind in ('given_f', 'given_m')").groupBy("entity").agg(F.max(F.struct("n", "kind"))["kind"].alias("as_kind"))
    return found.where("kind = 'given_u'").join(known, "entity").select("entity", "as_kind").checkpoint()


def _draw_again(found: DataFrame, drawn_for: DataFrame, key: str, rounds: int) -> DataFrame | None:
    """``kind, entity, surrogate`` of entities to draw for whose first surrogate collides; None if none does."""
    taken, waiting, moved = None, drawn_for.select("kind", "entity", F.lit(0).alias("attempt")), None
    for _ in range(rounds):
        drawn = waiting.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("entity"), F.col("attempt")))
        real = found.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        used = real if taken is None else real.unionAll(taken.select("kind", "surrogate", F.lit(True)))
        first = Window.partitionBy("kind", "surrogate").orderBy("entity")
        drawn = (drawn.withColumn("nth", F.row_number().over(first)).join(used.distinct(), ["kind", "surrogate"], "left")
                 .withColumn("good", (F.col("nth") == 1) & F.col("real").isNull()).drop("nth", "real").checkpoint())
        good = drawn.where("good").select("kind", "entity", "surrogate", "attempt")
        taken = good if taken is None else taken.unionAll(good)
        again = good.where("attempt > 0").select("kind", "entity", "surrogate")
        moved = again if moved is None else moved.unionAll(again)
        waiting = drawn.where("not good").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            return None if moved.isEmpty() else moved
    raise RuntimeError(f"surrogates still collide after {rounds} attempts")


def replace(docs: DataFrame, key: str, text: str = "text", rounds: int = 50) -> DataFrame:
    """The table with every detected entity of ``text`` replaced, all columns as they are."""
    scratch_dir(docs.sparkSession)
    t = F.col(text).cast("string")
    holds = t.rlike(HINT) & t.rlike(ANY)
    matches = F.regexp_extract_all(t, F.lit(ANY), F.lit(0))
    # every occurrence is reduced to distinct entities before anything is shuffled
    found = (docs.where(holds).select(F.explode(F.flatten(F.transform(matches, entities))).alias("e"))
             .where("e.kind <> 'particle'").groupBy("e.kind", "e.entity").agg(F.count(F.lit(1)).alias("n")).select("kind", "entity", "n").checkpoint())
    shared = _shared_given(found)
    if shared.isEmpty():
        moved = _draw_again(found, found, key, rounds)
    else:
        same = shared.select(F.lit("given_u").alias("kind"), "entity")
        moved = _draw_again(found, found.join(same, ["kind", "entity"], "left_anti"), key, rounds)
        own = surrogate(key, F.col("as_kind"), F.col("entity"), F.lit(0))
        if moved is not None:
            shared = shared.join(moved.select(F.col("kind").alias("as_kind"), "entity", F.col("surrogate").alias("again")), ["as_kind", "entity"], "left")
            own = F.coalesce("again", own)
        shared = shared.select(F.lit("given_u").alias("kind"), "entity", own.alias("surrogate"))
        moved = (shared if moved is None else moved.unionAll(shared)).checkpoint()

    def rewritten(other: Column | None) -> Column:
        def new(e: Column) -> Column:
            own = surrogate(key, e["kind"], e["entity"], F.lit(0))
            return own if other is None else F.coalesce(F.try_element_at(other, F.concat_ws("\u0001", e["kind"], e["entity"])), own)

        def drawn(m: Column) -> Column:
            es = F.transform(entities(m), lambda e: F.struct(e["kind"].alias("kind"), e["entity"].alias("entity"), new(e).alias("new")))
            return F.struct(m.alias("m"), es.alias("es"))

        def named(found: Column) -> Column:
            by_word = _let(_names(F.flatten(F.transform(found, lambda d: d["es"]))), lambda names: F.map_from_arrays(
                F.transform(names, lambda e: e["entity"]), F.transform(names, lambda e: e["new"])))
            return _let(F.when(t.rlike(NAME), by_word), lambda known: joined(found, known))

        def joined(found: Column, known: Column) -> Column:
            written = F.transform(found, lambda d: rendered(d["m"], F.transform(d["es"], lambda e: e["new"])))
            return F.concat_ws("", F.zip_with(F.split(t, ANY, -1), written, lambda g, s: F.concat(
                F.when(known.isNull(), g).otherwise(_mentions(g, known)), F.coalesce(s, F.lit("")))))

        return _let(F.transform(matches, drawn), named)

    if moved is None:
        return docs.withColumn(text, F.when(holds, rewritten(None)).otherwise(t))
    # texts that hold a moved entity, with all such entities of theirs; the columns get names that the table does not have
    sha, other, mine = (_unused(docs, c) for c in ("__sha", "__moved", "__key"))
    held = (docs.where(holds).select(F.sha2(t, 256).alias(sha), F.explode(F.array_distinct(F.flatten(F.transform(matches, entities)))).alias("e"))
            .select(sha, "e.kind", "e.entity").join(moved, ["kind", "entity"]).distinct()
            .groupBy(sha).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "entity"), "surrogate"))).alias(other)))
    return (docs.withColumn(mine, F.sha2(t, 256)).join(held, F.col(mine) == F.col(sha), "left")
            .withColumn(text, F.when(holds, rewritten(F.col(other))).otherwise(t)).select(*[F.col(f"`{c}`") for c in docs.columns]))


def _unused(df: DataFrame, name: str) -> str:
    """The name, longer where the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
