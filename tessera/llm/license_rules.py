"""The signature rules of the licence scan, in order of priority.

A rule is a line ``label | weight | pattern`` under the heading of its priority. Patterns see a text as its words in
lower case, one space between them: ``GPL-2.0-only`` reads ``gpl 2 0 only``. ``{...}`` stands for a
fragment of FRAGMENTS. A pattern's words outside of groups must all stand in a text before it is tried; every rule needs one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

FRAGMENTS = {
    "v": "(?:version |v ?)?",
    "0": "(?: 0)?",
    "lic": "(?:license|licence)",
    "lics": "(?:licenses|licences|license|licence)",
    "under": "(?:licensed|licenced|released|distributed|available|provided|published|offered|covered) under",
    "the": "(?:the )?",
    "terms": "(?:the )?(?:terms of )?(?:the )?",
    "gap4": "(?:[^ ]+ ){0,4}",
    "gap9": "(?:[^ ]+ ){0,9}",
    "later": "(?:or )?(?:any later|later|newer)",
}

#: Identifiers of SPDX, as a tag names them; each gives a rule of the first priority.
IDENTIFIERS = """
0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-1.0 apsl-1.1 apsl-1.2
apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause
bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-1.0
cc-by-nc-2.0 cc-by-nc-2.5 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-2.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-2.0
cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-2.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-1.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0
cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-1.0 cecill-1.1 cecill-2.0 cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0 curl ecl-1.0
ecl-2.0 efl-1.0 efl-2.0 epl-1.0 epl-2.0 eupl-1.0 eupl-1.1 eupl-1.2 fair fsfap ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0
hpnd icu ijg imagemagick ipl-1.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng lppl-1.0 lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl
ms-rl mulanpsl-1.0 mulanpsl-2.0 ncsa nposl-3.0 ntp odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-1.0 osl-2.0 osl-2.1 osl-3.0 pddl-1.0
php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 rpl-1.1 rpl-1.5 ruby sgi-b-2.0 sissl sleepycat spl-1.0 sspl-1.0 tcl unicode-dfs-2015
unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 xnet zlib zpl-2.0 zpl-2.1
"""

RULES = """
# 2: sentences that only the text of a licence has
mit | 0.98 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 0.95 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 0.95 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction (?:[^ ]+ ){18,28}persons to whom the software is furnished to do so the software is provided as is
x11 | 0.95 | except as contained in this notice the names? of {gap9}shall not be used in advertising
isc | 0.97 | permission to use copy modify (?:and or|and) distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | 0.97 | permission to use copy modify (?:and or|and) distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | 0.9 | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
ntp | 0.9 | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that
bsd | 0.9 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause | 0.95 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by
bsd-3-clause | 0.95 | neither the names? of {gap9}(?:nor the names of )?(?:its|their|the|any) contributors may be used to endorse or promote products derived from this software
bsd-4-clause | 0.97 | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause-clear | 0.95 | no express or implied licenses to any party s patent rights are granted by this license
bsd-3-clause-no-nuclear | 0.9 | not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility
apache-2.0 | 0.98 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | 0.98 | apache license version 2 0 january 2004
apache-2.0 | 0.9 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1 | 0.95 | this product includes software developed by the apache (?:software foundation|group) http www apache org
apache-1.0 | 0.9 | products derived from this software may not be called apache
gpl-1.0 | 0.97 | gnu general public license version 1 february 1989
gpl-2.0 | 0.98 | gnu general public license version 2 june 1991
gpl-3.0 | 0.98 | gnu general public license version 3 29 june 2007
gpl-1.0-or-later | 0.95 | terms of the gnu general public license as published by the free software foundation either version 1 (?:of the license )?or
gpl-2.0-or-later | 0.97 | terms of the gnu general public license as published by the free software foundation either version 2 (?:of the license )?or
gpl-3.0-or-later | 0.97 | terms of the gnu general public license as published by the free software foundation either version 3 (?:of the license )?or
gpl-2.0-only | 0.97 | terms of the gnu general public license version 2 (?:only )?as published by the free software foundation
gpl-3.0-only | 0.97 | terms of the gnu general public license version 3 (?:only )?as published by the free software foundation
gpl | 0.85 | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | 0.9 | the licenses for most software and other practical works are designed to take away your freedom to share and change the works
gpl | 0.8 | you should have received a copy of the gnu general public license along with
lgpl | 0.8 | you should have received a copy of the gnu (?:lesser|library) general public license along with
agpl | 0.8 | you should have received a copy of the gnu affero general public license along with
lgpl-2.0 | 0.97 | gnu library general public license version 2 june 1991
lgpl-2.1 | 0.97 | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | 0.97 | gnu lesser general public license version 3 29 june 2007
lgpl-2.0-or-later | 0.96 | terms of the gnu library general public license as published by the free software foundation either version 2
lgpl-2.1-or-later | 0.96 | terms of the gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3.0-or-later | 0.96 | terms of the gnu lesser general public license as published by the free software foundation either version 3
agpl-3.0 | 0.97 | gnu affero general public license version 3 19 november 2007
agpl-3.0-or-later | 0.96 | terms of the gnu affero general public license as published by the free software foundation either version 3
gfdl | 0.95 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gcc-exception | 0.9 | gcc runtime library exception
classpath-exception | 0.9 | linking this library statically or dynamically with other modules is making a combined work based on this library
autoconf-exception | 0.85 | as a special exception (?:to the gnu general public license )?if you distribute this file as part of a program that contains a configuration script generated by autoconf
mpl-1.1 | 0.96 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | 0.96 | the contents of this file are subject to the mozilla public license version 1 0
mpl-2.0 | 0.97 | this source code form is subject to the terms of the mozilla public license v 2 0
npl-1.1 | 0.96 | the contents of this file are subject to the netscape public license version 1 1
cpl-1.0 | 0.9 | the accompanying program is provided under the terms of this common public license agreement
epl | 0.9 | the accompanying program is provided under the terms of this eclipse public license
epl-1.0 | 0.95 | made available under the terms of the eclipse public license v ?1 0
epl-2.0 | 0.95 | made available under the terms of the eclipse public license (?:v ?)?2 0
edl-1.0 | 0.9 | eclipse distribution license v ?1 0
cddl | 0.95 | subject to the terms of the common development and distribution license
cddl-1.0 | 0.95 | common development and distribution license cddl version 1 0
cddl-1.1 | 0.95 | common development and distribution license cddl version 1 1
sspl-1.0 | 0.95 | server side public license version 1 october 16 2018
busl-1.1 | 0.95 | the business source license this document or the license is not an open source license
elastic-2.0 | 0.9 | you may not provide the software to third parties as a hosted or managed service
artistic-1.0 | 0.9 | the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | 0.95 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms
boost-1.0 | 0.97 | boost software license version 1 0 august 17th 2003
boost-1.0 | 0.95 | distributed under the boost software license version 1 0
zlib | 0.96 | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
libpng | 0.93 | the contributing authors and glenn randers pehrson
unlicense | 0.97 | this is free and unencumbered software released into the public domain
wtfpl | 0.97 | do what the fuck you want to public license
beerware | 0.95 | the beer ware license revision 42
postgresql | 0.95 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
psf | 0.95 | this license agreement is between the python software foundation
openssl | 0.95 | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 0.95 | this product includes cryptographic software written by eric young
ofl-1.1 | 0.97 | sil open font license version 1 1 26 february 2007
ofl-1.1 | 0.95 | this font software is licensed under the sil open font license version 1 1
unicode | 0.93 | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
w3c | 0.93 | by obtaining (?:using and or copying|and or copying) this work you the licensee agree that you have read understood and will comply
ijg | 0.93 | this software is based in part on the work of the independent jpeg group
ftl | 0.93 | portions of this software are copyright {gap4}the freetype project
ms-pl | 0.9 | this license governs use of the accompanying software if you use the software you accept this license
cecill | 0.9 | this software is governed by the cecill (?:c |b )?license under french law
odbl-1.0 | 0.93 | open data commons open database license odbl
pddl-1.0 | 0.93 | open data commons public domain dedication and license
odc-by-1.0 | 0.93 | open data commons attribution license
cc0-1.0 | 0.95 | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 | 0.95 | creative commons corporation is not a law firm {gap9}cc0
json | 0.95 | the software shall be used for good not evil
facebook-patent | 0.85 | additional grant of patent rights version 2
commons-clause | 0.9 | without limiting other conditions in the license the grant of rights under the license will not include
openrail | 0.85 | attachment a use restrictions you agree not to use the model
llama | 0.9 | llama (?:[0-9]+ )(?:[0-9]+ )?community license agreement

# 3: notices that put a work under a licence, with its version
apache-2.0 | 0.9 | {under} {terms}apache {lic} {v}2{0}
apache-1.1 | 0.9 | {under} {terms}apache {lic} {v}1 1
gpl-2.0-or-later | 0.92 | {under} {terms}gnu general public {lic} {v}2{0} {later}
gpl-3.0-or-later | 0.92 | {under} {terms}gnu general public {lic} {v}3{0} {later}
gpl-2.0 | 0.9 | {under} {terms}gnu general public {lic} {v}2{0}
gpl-3.0 | 0.9 | {under} {terms}gnu general public {lic} {v}3{0}
lgpl-2.1-or-later | 0.92 | {under} {terms}gnu lesser general public {lic} {v}2 1 {later}
lgpl-3.0-or-later | 0.92 | {under} {terms}gnu lesser general public {lic} {v}3{0} {later}
lgpl-2.1 | 0.9 | {under} {terms}gnu lesser general public {lic} {v}2 1
lgpl-3.0 | 0.9 | {under} {terms}gnu lesser general public {lic} {v}3{0}
agpl-3.0-or-later | 0.92 | {under} {terms}gnu affero general public {lic} {v}3{0} {later}
agpl-3.0 | 0.9 | {under} {terms}gnu affero general public {lic} {v}3{0}
mit | 0.9 | {under} {terms}mit {lic}
mit | 0.88 | {under} {terms}(?:x11 mit|mit x11|expat) {lic}
mpl-2.0 | 0.9 | {under} {terms}mozilla public {lic} {v}2{0}
epl-2.0 | 0.9 | {under} {terms}eclipse public {lic} {v}2{0}
epl-1.0 | 0.9 | {under} {terms}eclipse public {lic} {v}1{0}
eupl-1.2 | 0.9 | {under} {terms}european union public {lic} {v}1 2
eupl-1.1 | 0.9 | {under} {terms}european union public {lic} {v}1 1
boost-1.0 | 0.9 | {under} {terms}boost software {lic}
artistic-2.0 | 0.9 | {under} {terms}artistic {lic} {v}2{0}
perl | 0.85 | under the same terms as perl(?: itself)?
ruby | 0.85 | under the same terms as ruby(?: itself)?
bsd-3-clause | 0.9 | {under} {terms}(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd)(?: {lic})?
bsd-2-clause | 0.9 | {under} {terms}(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd)(?: {lic})?
bsd-4-clause | 0.9 | {under} {terms}(?:4 clause bsd|bsd 4 clause|original bsd|old bsd)(?: {lic})?
bsd | 0.8 | {under} {terms}bsd(?: style)? {lic}
isc | 0.88 | {under} {terms}isc {lic}
zlib | 0.88 | {under} {terms}zlib(?: libpng)? {lic}
unlicense | 0.88 | {under} {terms}unlicense
wtfpl | 0.88 | {under} {terms}wtfpl
cc0-1.0 | 0.9 | {under} {terms}cc0(?: 1 0)?(?: universal)?
gfdl | 0.88 | {under} {terms}gnu free documentation {lic}
cc-by-4.0 | 0.93 | {under} {terms}(?:a )?(?:creative commons attribution|cc by) 4 0
cc-by-3.0 | 0.93 | {under} {terms}(?:a )?(?:creative commons attribution|cc by) 3 0
cc-by-sa-4.0 | 0.93 | {under} {terms}(?:a )?(?:creative commons attribution share ?alike|cc by sa) 4 0
cc-by-sa-3.0 | 0.93 | {under} {terms}(?:a )?(?:creative commons attribution share ?alike|cc by sa) 3 0
cc-by-nc-4.0 | 0.93 | {under} {terms}(?:a )?(?:creative commons attribution non ?commercial|cc by nc) 4 0
cc-by-nc-3.0 | 0.93 | {under} {terms}(?:a )?(?:creative commons attribution non ?commercial|cc by nc) 3 0
cc-by-nd-4.0 | 0.93 | {under} {terms}(?:a )?(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd) 4 0
cc-by-nc-sa-4.0 | 0.93 | {under} {terms}(?:a )?(?:creative commons attribution non ?commercial share ?alike|cc by nc sa) 4 0
cc-by-nc-sa-3.0 | 0.93 | {under} {terms}(?:a )?(?:creative commons attribution non ?commercial share ?alike|cc by nc sa) 3 0
cc-by-nc-nd-4.0 | 0.93 | {under} {terms}(?:a )?(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd) 4 0
odbl-1.0 | 0.9 | {under} {terms}open database {lic}
public-domain | 0.85 | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
mit-or-apache-2.0 | 0.9 | licensed under either of apache {lic} version 2 0
proprietary | 0.8 | this (?:file|software|program|document|material) is (?:the )?(?:proprietary|confidential) (?:and [^ ]+ )?(?:information|property) of
proprietary | 0.8 | unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|program|document|material) {gap9}strictly prohibited

# 4: names and abbreviations with a version
apache-2.0 | 0.8 | apache {lic} {v}2{0}
apache-2.0 | 0.75 | apache 2 0(?: {lic})?
apache-2.0 | 0.75 | asl 2 0
apache-1.1 | 0.8 | apache {lic} {v}1 1
apache-1.0 | 0.8 | apache {lic} {v}1 0
gpl-1.0 | 0.75 | gnu general public {lic} {v}1(?: 0)?
gpl-2.0 | 0.8 | gnu general public {lic} {v}2{0}
gpl-3.0 | 0.8 | gnu general public {lic} {v}3{0}
gpl-2.0-or-later | 0.82 | gnu general public {lic} {v}2{0} {later}
gpl-3.0-or-later | 0.82 | gnu general public {lic} {v}3{0} {later}
gpl-2.0 | 0.75 | gpl {v}2{0}
gpl-2.0 | 0.75 | gplv2
gpl-3.0 | 0.75 | gpl {v}3{0}
gpl-3.0 | 0.75 | gplv3
gpl-2.0-only | 0.8 | gpl {v}2{0} only
gpl-3.0-only | 0.8 | gpl {v}3{0} only
gpl-2.0-or-later | 0.8 | gpl {v}2{0} {later}
gpl-3.0-or-later | 0.8 | gpl {v}3{0} {later}
gpl-2.0-or-later | 0.78 | gplv2 {later}
gpl-3.0-or-later | 0.78 | gplv3 {later}
gpl-2.0-or-later | 0.75 | gpl2 {later}
lgpl-2.0 | 0.8 | gnu (?:library|lesser) general public {lic} {v}2{0}
lgpl-2.1 | 0.8 | gnu (?:library|lesser) general public {lic} {v}2 1
lgpl-3.0 | 0.8 | gnu lesser general public {lic} {v}3{0}
lgpl-2.1-or-later | 0.82 | gnu (?:library|lesser) general public {lic} {v}2 1 {later}
lgpl-3.0-or-later | 0.82 | gnu lesser general public {lic} {v}3{0} {later}
lgpl-2.0 | 0.74 | lgpl {v}2{0}
lgpl-2.1 | 0.76 | lgpl {v}2 1
lgpl-2.1 | 0.75 | lgplv2 1
lgpl-3.0 | 0.75 | lgpl {v}3{0}
lgpl-3.0 | 0.75 | lgplv3
lgpl-2.1-or-later | 0.8 | lgpl {v}2 1 {later}
lgpl-3.0-or-later | 0.8 | lgpl {v}3{0} {later}
agpl-1.0 | 0.75 | affero general public {lic} {v}1(?: 0)?
agpl-3.0 | 0.8 | gnu affero general public {lic} {v}3{0}
agpl-3.0-or-later | 0.82 | gnu affero general public {lic} {v}3{0} {later}
agpl-3.0 | 0.75 | agpl {v}3{0}
agpl-3.0 | 0.75 | agplv3
agpl-3.0-or-later | 0.8 | agpl {v}3{0} {later}
gfdl-1.1 | 0.8 | gnu free documentation {lic} {v}1 1
gfdl-1.2 | 0.8 | gnu free documentation {lic} {v}1 2
gfdl-1.3 | 0.8 | gnu free documentation {lic} {v}1 3
gfdl-1.2 | 0.74 | gfdl {v}1 2
gfdl-1.3 | 0.74 | gfdl {v}1 3
bsd-0-clause | 0.78 | (?:0|zero) clause bsd(?: {lic})?
bsd-1-clause | 0.78 | (?:1|one) clause bsd(?: {lic})?
bsd-2-clause | 0.78 | (?:2|two) clause bsd(?: {lic})?
bsd-3-clause | 0.78 | (?:3|three) clause bsd(?: {lic})?
bsd-4-clause | 0.78 | (?:4|four) clause bsd(?: {lic})?
bsd-2-clause | 0.78 | bsd 2 clause(?: {lic})?
bsd-3-clause | 0.78 | bsd 3 clause(?: {lic})?
bsd-4-clause | 0.78 | bsd 4 clause(?: {lic})?
bsd-3-clause-clear | 0.8 | bsd 3 clause clear(?: {lic})?
bsd-2-clause-patent | 0.8 | bsd 2 clause patent(?: {lic})?
bsd-2-clause | 0.75 | simplified bsd {lic}
bsd-3-clause | 0.75 | (?:new|modified|revised) bsd {lic}
bsd-4-clause | 0.75 | (?:original|old) bsd {lic}
mpl-1.0 | 0.78 | mozilla public {lic} {v}1 0
mpl-1.1 | 0.78 | mozilla public {lic} {v}1 1
mpl-2.0 | 0.8 | mozilla public {lic} {v}2{0}
mpl-1.1 | 0.74 | mpl {v}1 1
mpl-2.0 | 0.75 | mpl {v}2{0}
mpl-2.0 | 0.74 | mplv2
epl-1.0 | 0.78 | eclipse public {lic} {v}1{0}
epl-2.0 | 0.78 | eclipse public {lic} {v}2{0}
epl-1.0 | 0.74 | epl {v}1 0
epl-2.0 | 0.74 | epl {v}2 0
eupl-1.0 | 0.78 | european union public {lic} {v}1 0
eupl-1.1 | 0.78 | european union public {lic} {v}1 1
eupl-1.2 | 0.78 | european union public {lic} {v}1 2
eupl-1.1 | 0.74 | eupl {v}1 1
eupl-1.2 | 0.74 | eupl {v}1 2
cddl-1.0 | 0.78 | cddl {v}1 0
cddl-1.1 | 0.78 | cddl {v}1 1
cpl-1.0 | 0.76 | common public {lic} {v}1 0
cpal-1.0 | 0.76 | common public attribution {lic} {v}1 0
ipl-1.0 | 0.76 | ibm public {lic} {v}1 0
spl-1.0 | 0.76 | sun public {lic} {v}1 0
osl-1.0 | 0.76 | open software {lic} {v}1 0
osl-2.0 | 0.76 | open software {lic} {v}2 0
osl-2.1 | 0.76 | open software {lic} {v}2 1
osl-3.0 | 0.76 | open software {lic} {v}3 0
nposl-3.0 | 0.78 | non profit open software {lic} {v}3 0
afl-2.1 | 0.76 | academic free {lic} {v}2 1
afl-3.0 | 0.76 | academic free {lic} {v}3 0
apsl-1.0 | 0.76 | apple public source {lic} {v}1 0
apsl-2.0 | 0.76 | apple public source {lic} {v}2{0}
artistic-1.0 | 0.76 | artistic {lic} {v}1 0
artistic-2.0 | 0.78 | artistic {lic} {v}2{0}
boost-1.0 | 0.78 | boost software {lic} {v}1 0
ecl-2.0 | 0.76 | educational community {lic} {v}2 0
efl-2.0 | 0.76 | eiffel forum {lic} {v}2
lppl-1.0 | 0.76 | latex project public {lic} {v}1 0
lppl-1.2 | 0.76 | latex project public {lic} {v}1 2
lppl-1.3c | 0.76 | latex project public {lic} {v}1 3c?
ms-pl | 0.76 | microsoft public {lic}
ms-rl | 0.76 | microsoft reciprocal {lic}
mulanpsl-1.0 | 0.76 | mulan permissive software {lic} {v}1
mulanpsl-2.0 | 0.76 | mulan permissive software {lic} {v}2
ofl-1.0 | 0.76 | sil open font {lic} {v}1 0
ofl-1.1 | 0.78 | sil open font {lic} {v}1 1
php-3.0 | 0.76 | php {lic} {v}3 0
php-3.01 | 0.76 | php {lic} {v}3 01
psf-2.0 | 0.76 | python software foundation {lic} {v}2
psf-2.0 | 0.74 | psf {lic} {v}2
qpl-1.0 | 0.76 | q public {lic} {v}1 0
rpl-1.5 | 0.76 | reciprocal public {lic} {v}1 5
sspl-1.0 | 0.78 | server side public {lic}(?: {v}1)?
busl-1.1 | 0.78 | business source {lic} {v}1 1
upl-1.0 | 0.76 | universal permissive {lic} {v}1 0
zpl-2.0 | 0.76 | zope public {lic} {v}2 0
zpl-2.1 | 0.76 | zope public {lic} {v}2 1
elastic-2.0 | 0.78 | elastic {lic} {v}2(?: 0)?
polyform-noncommercial-1.0.0 | 0.78 | polyform noncommercial {lic}(?: 1 0 0)?
polyform-small-business-1.0.0 | 0.78 | polyform small business {lic}(?: 1 0 0)?
blueoak-1.0.0 | 0.78 | blue oak model {lic} 1 0 0
odbl-1.0 | 0.78 | odbl {v}1 0
odc-by-1.0 | 0.76 | odc by {v}1 0
pddl-1.0 | 0.76 | pddl {v}1 0
cc0-1.0 | 0.8 | cc0 {v}1 0(?: universal)?
cc0-1.0 | 0.78 | creative commons zero(?: {v}1 0)?(?: universal)?
cc-by-1.0 | 0.8 | cc by 1 0
cc-by-2.0 | 0.8 | cc by 2 0
cc-by-2.5 | 0.8 | cc by 2 5
cc-by-3.0 | 0.8 | cc by 3 0
cc-by-4.0 | 0.82 | cc by 4 0
cc-by-sa-1.0 | 0.8 | cc by sa 1 0
cc-by-sa-2.0 | 0.8 | cc by sa 2 0
cc-by-sa-2.5 | 0.8 | cc by sa 2 5
cc-by-sa-3.0 | 0.8 | cc by sa 3 0
cc-by-sa-4.0 | 0.82 | cc by sa 4 0
cc-by-nc-2.0 | 0.8 | cc by nc 2 0
cc-by-nc-2.5 | 0.8 | cc by nc 2 5
cc-by-nc-3.0 | 0.8 | cc by nc 3 0
cc-by-nc-4.0 | 0.82 | cc by nc 4 0
cc-by-nd-2.0 | 0.8 | cc by nd 2 0
cc-by-nd-3.0 | 0.8 | cc by nd 3 0
cc-by-nd-4.0 | 0.82 | cc by nd 4 0
cc-by-nc-sa-2.0 | 0.8 | cc by nc sa 2 0
cc-by-nc-sa-3.0 | 0.8 | cc by nc sa 3 0
cc-by-nc-sa-4.0 | 0.82 | cc by nc sa 4 0
cc-by-nc-nd-2.0 | 0.8 | cc by nc nd 2 0
cc-by-nc-nd-3.0 | 0.8 | cc by nc nd 3 0
cc-by-nc-nd-4.0 | 0.82 | cc by nc nd 4 0
cc-by-2.0 | 0.8 | creative commons attribution 2 0
cc-by-3.0 | 0.8 | creative commons attribution 3 0
cc-by-4.0 | 0.82 | creative commons attribution 4 0
cc-by-sa-3.0 | 0.8 | creative commons attribution share ?alike 3 0
cc-by-sa-4.0 | 0.82 | creative commons attribution share ?alike 4 0
cc-by-nc-4.0 | 0.82 | creative commons attribution non ?commercial 4 0
cc-by-nd-4.0 | 0.82 | creative commons attribution no ?deriv(?:ative)?s 4 0
cc-by-nc-sa-4.0 | 0.82 | creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-nd-4.0 | 0.82 | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0

# 5: names without a version, and addresses
apache | 0.6 | apache (?:software )?{lic}
gpl | 0.6 | gnu general public {lic}
gpl | 0.55 | gnu gpl
lgpl | 0.6 | gnu (?:lesser|library) general public {lic}
lgpl | 0.55 | gnu lgpl
agpl | 0.6 | gnu affero general public {lic}
agpl | 0.55 | gnu agpl
gfdl | 0.6 | gnu free documentation {lic}
gpl-linking-exception | 0.6 | gpl (?:with )?linking exception
classpath-exception | 0.65 | (?:with )?classpath exception
mit | 0.6 | mit {lic}
mit | 0.55 | expat {lic}
bsd | 0.55 | bsd(?: style)? {lic}
isc | 0.55 | isc {lic}
mpl | 0.6 | mozilla public {lic}
npl | 0.6 | netscape public {lic}
epl | 0.6 | eclipse public {lic}
edl | 0.6 | eclipse distribution {lic}
eupl | 0.6 | european union public {lic}
cddl | 0.6 | common development and distribution {lic}
cpl | 0.6 | common public {lic}
osl | 0.6 | open software {lic}
afl | 0.6 | academic free {lic}
apsl | 0.6 | apple public source {lic}
artistic | 0.55 | artistic {lic}
boost | 0.6 | boost software {lic}
ecl | 0.6 | educational community {lic}
lppl | 0.6 | latex project public {lic}
mulanpsl | 0.6 | mulan permissive software {lic}
ofl | 0.6 | (?:sil )?open font {lic}
php | 0.55 | php {lic}
psf | 0.6 | python software foundation {lic}
ruby | 0.5 | ruby {lic}
tcl | 0.5 | tcl tk {lic}
vim | 0.5 | vim {lic}
zlib | 0.55 | zlib(?: libpng)? {lic}
libpng | 0.55 | libpng {lic}
unlicense | 0.6 | the unlicense
wtfpl | 0.6 | wtfpl
beerware | 0.55 | beer ?ware {lic}
postgresql | 0.55 | postgresql {lic}
openssl | 0.55 | openssl {lic}
ncsa | 0.6 | university of illinois ncsa open source {lic}
busl | 0.6 | business source {lic}
elastic | 0.55 | elastic {lic}
upl | 0.6 | universal permissive {lic}
odbl | 0.6 | open database {lic}
cc0 | 0.6 | cc0
cc-by | 0.6 | creative commons attribution(?: {lic})?
cc-by-sa | 0.65 | creative commons attribution share ?alike(?: {lic})?
cc-by-nc | 0.65 | creative commons attribution non ?commercial(?: {lic})?
cc-by-nd | 0.65 | creative commons attribution no ?deriv(?:ative)?s(?: {lic})?
cc-by-nc-sa | 0.68 | creative commons attribution non ?commercial share ?alike(?: {lic})?
cc-by-nc-nd | 0.68 | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: {lic})?
cc-by-sa | 0.62 | cc by sa
cc-by-nc | 0.62 | cc by nc
cc-by-nd | 0.62 | cc by nd
cc-by-nc-sa | 0.64 | cc by nc sa
cc-by-nc-nd | 0.64 | cc by nc nd
apache-2.0 | 0.75 | apache org licenses license 2 0
apache-1.1 | 0.75 | apache org licenses license 1 1
gpl-2.0 | 0.7 | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | 0.7 | gnu org licenses gpl 3 0
gpl | 0.6 | gnu org (?:copyleft|licenses) gpl
lgpl-2.1 | 0.7 | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | 0.7 | gnu org licenses lgpl 3 0
lgpl | 0.6 | gnu org (?:copyleft|licenses) (?:lgpl|lesser)
agpl-3.0 | 0.7 | gnu org licenses agpl 3 0
gfdl | 0.6 | gnu org (?:copyleft|licenses) fdl
mit | 0.7 | opensource org {lics} mit(?: license)?
bsd-2-clause | 0.7 | opensource org {lics} bsd 2 clause
bsd-3-clause | 0.7 | opensource org {lics} bsd 3 clause
isc | 0.65 | opensource org {lics} isc
mpl-2.0 | 0.72 | mozilla org (?:[^ ]+ )?mpl 2 0
mpl-1.1 | 0.72 | mozilla org (?:[^ ]+ )?mpl mpl 1 1
epl-1.0 | 0.72 | eclipse org legal epl v10
epl-2.0 | 0.72 | eclipse org legal epl (?:2 0|v20)
boost-1.0 | 0.72 | boost org license 1 0
unlicense | 0.7 | unlicense org
wtfpl | 0.65 | wtfpl net
cc0-1.0 | 0.75 | creativecommons org publicdomain zero 1 0
public-domain | 0.7 | creativecommons org publicdomain mark 1 0
cc-by-2.0 | 0.75 | creativecommons org licenses by 2 0
cc-by-3.0 | 0.75 | creativecommons org licenses by 3 0
cc-by-4.0 | 0.75 | creativecommons org licenses by 4 0
cc-by-sa-3.0 | 0.75 | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | 0.75 | creativecommons org licenses by sa 4 0
cc-by-nc-3.0 | 0.75 | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | 0.75 | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | 0.75 | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | 0.75 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 0.75 | creativecommons org licenses by nc nd 4 0
odbl-1.0 | 0.72 | opendatacommons org licenses odbl
ofl-1.1 | 0.7 | scripts sil org ofl

# 6: remarks on rights that name no licence
proprietary | 0.4 | all rights reserved
proprietary | 0.5 | proprietary and confidential
proprietary | 0.45 | commercial {lic} (?:agreement|required)
proprietary | 0.45 | end user {lic} agreement
public-domain | 0.45 | (?:is|are) in the public domain
public-domain | 0.45 | public domain dedication
public-domain | 0.4 | dominio público
public-domain | 0.4 | domaine public
public-domain | 0.4 | gemeinfrei
no-ai-training | 0.5 | may not be used (?:to train|for training) {gap4}(?:models?|systems?|ai)
cc | 0.4 | (?:a )?creative commons {lic}
cc | 0.4 | licence creative commons
cc | 0.4 | licencia creative commons
cc | 0.4 | creative commons lizenz
dual-licence | 0.4 | dual licensed
see-licence-file | 0.35 | see (?:the )?(?:file )?(?:license|licence|copying)(?: [^ ]+)? file for
see-licence-file | 0.35 | (?:license|licence) that can be found in the (?:license|licence) file
open-source | 0.3 | (?:an )?open source {lic}
"""

#: The phrases every scan reports, with their labels; nothing suppresses them.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_WEIGHT = 0.5


@dataclass(frozen=True)
class Rule:
    label: str
    weight: float
    pattern: re.Pattern
    priority: int
    needs: frozenset[bytes]


_OPTIONAL = re.compile(r"^(?:\(\?:[^()]* \)\?)+|(?:\(\?: [^()]*\)\?)+$")


def needed(pattern: str) -> frozenset[bytes]:
    """The plain words outside of groups: a text without one of them can't match."""
    words, word, depth = [], "", 0
    for c in pattern + " ":
        depth += (c == "(") - (c == ")")
        if c == " " and not depth:
            words.append(_OPTIONAL.sub("", word))
            word = ""
        else:
            word += c
    return frozenset(w.encode() for w in words if re.fullmatch("[a-z0-9\u0080-\U0010ffff]+", w))


def rule(label: str, weight: float, pattern: str, priority: int) -> Rule:
    for name, fragment in FRAGMENTS.items():
        pattern = pattern.replace("{" + name + "}", fragment)
    needs = needed(pattern)
    if not needs:
        raise ValueError(f"no word is always in {pattern!r}")
    return Rule(label, weight, re.compile(b"(?<= )(?:" + pattern.encode() + b")(?= )"), priority, needs)


def all_rules() -> list[Rule]:
    """Every rule, best priority first, in the order of the lines above."""
    out = []
    for name in IDENTIFIERS.split():
        words = " ".join(re.findall("[a-z0-9]+", name))
        out.append(rule(name, 0.99, f"spdx {{lic}} identifier {words}", 1))
        if "gpl" in name or "gfdl" in name:
            out.append(rule(f"{name}-only", 0.99, f"spdx {{lic}} identifier {words} only", 1))
            out.append(rule(f"{name}-or-later", 0.99, f"spdx {{lic}} identifier {words} or later", 1))
    priority = 0
    for line in RULES.strip().splitlines():
        if line.startswith("# "):
            priority = int(line[2:line.index(":")])
        elif line:
            label, weight, pattern = line.split(" | ", 2)
            out.append(rule(label, float(weight), pattern, priority))
    return out
