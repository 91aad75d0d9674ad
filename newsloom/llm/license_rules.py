"""Signature rules of the license scan.

A rule is ``label | priority | confidence | keyword | pattern``.  Patterns run over the words of a text,
lower-cased and joined by single blanks ("2.0" is "2 0"), and match whole words only.  A rule is tried
only where its keyword occurs, so every match of the pattern has to contain the keyword.  Lower priority
numbers win: 1 verbatim license text, 2 notices and names with a version, 3 identifiers and names without a
version, 4 hints.
"""

from __future__ import annotations

from dataclasses import dataclass

# Base phrases and labels of the scan (fixed values).
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

_V = r"(?: the)?(?: terms of)?(?: the)?"   # filler between "under" and a name
_VER = r"(?: version| v| ver)?"

RULES_TEXT = rf"""
mit | 1 | 0.99 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?
mit | 1 | 0.9 | copyright notice and this permission notice | the above copyright notice and this permission notice shall be included
mit | 1 | 0.6 | without warranty of any kind | the software is provided as is without warranty of any kind express or implied
mit | 2 | 0.95 | mit license | (?:released|licensed|distributed|available|published|provided) under{_V} mit license
mit | 2 | 0.9 | mit license | the mit license(?: mit)?
mit | 3 | 0.8 | mit license | mit license
mit | 3 | 0.7 | mit licensed | mit licensed
mit-0 | 2 | 0.9 | mit no attribution | mit no attribution
x11 | 2 | 0.9 | x11 license | (?:mit )?x11 license
expat | 3 | 0.8 | expat license | expat license
apache-2.0 | 1 | 0.99 | you may not use this file except | licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance
apache-2.0 | 1 | 0.95 | obtain a copy of the license at | you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0 | 2 | 0.97 | apache license | (?:released|licensed|distributed|available) under{_V} apache license{_VER} 2(?: 0)?
apache-2.0 | 2 | 0.9 | apache license | apache license{_VER} 2(?: 0)?
apache-2.0 | 2 | 0.8 | apache 2 0 | apache 2 0(?: license| licence)?
apache-2.0 | 2 | 0.8 | apache org licenses | apache org licenses license 2 0
apache-1.1 | 2 | 0.9 | apache software license | apache software license{_VER} 1 1
apache-1.0 | 2 | 0.9 | apache software license | apache software license{_VER} 1 0
apache | 3 | 0.7 | apache license | apache license
apache | 3 | 0.7 | apache software license | apache software license
bsd-3-clause | 1 | 0.99 | neither the name of | neither the name of(?: [^ ]+){{1,12}}? nor the names of its contributors may be used to endorse
bsd-2-clause | 1 | 0.9 | redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause | 1 | 0.95 | all advertising materials | all advertising materials mentioning features or use of this software must display
bsd-3-clause | 2 | 0.9 | bsd | (?:3 clause|new|modified|revised) bsd(?: license| licence)?
bsd-2-clause | 2 | 0.9 | bsd | (?:2 clause|simplified|freebsd) bsd(?: license| licence)?
bsd-4-clause | 2 | 0.9 | bsd | (?:4 clause|original) bsd(?: license| licence)?
bsd-3-clause | 3 | 0.9 | bsd 3 clause | bsd 3 clause
bsd-2-clause | 3 | 0.9 | bsd 2 clause | bsd 2 clause
0bsd | 2 | 0.9 | zero clause bsd | zero clause bsd
bsd | 3 | 0.7 | bsd | bsd(?: style)? license
bsd | 3 | 0.6 | bsd style | bsd style
isc | 1 | 0.95 | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | 2 | 0.85 | isc license | (?:the )?isc license
zlib | 1 | 0.95 | altered source versions | altered source versions must be plainly marked as such
zlib | 2 | 0.85 | zlib | zlib(?: libpng)? license
libpng | 2 | 0.85 | libpng license | libpng license
unlicense | 1 | 0.95 | unencumbered software | this is free and unencumbered software released into the public domain
unlicense | 2 | 0.85 | the unlicense | the unlicense
wtfpl | 1 | 0.95 | do what the fuck | do what the fuck you want to public license
wtfpl | 3 | 0.8 | wtfpl | wtfpl
cc0-1.0 | 2 | 0.95 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | 1 | 0.95 | creative commons zero | creative commons zero(?: v1 0| 1 0)?(?: universal)?
public-domain | 2 | 0.8 | public domain | (?:dedicated to|released into|placed in|is in) the public domain
public-domain | 3 | 0.5 | public domain | public domain
gpl-3.0 | 1 | 0.98 | free software foundation | general public license as published by the free software foundation(?: either)? version 3
gpl-2.0 | 1 | 0.98 | free software foundation | general public license as published by the free software foundation(?: either)? version 2
gpl-3.0 | 2 | 0.97 | general public license | (?:this work is )?licensed under{_V} gnu general public license{_VER} 3(?: 0)?
gpl-2.0 | 2 | 0.97 | general public license | (?:this work is )?licensed under{_V} gnu general public license{_VER} 2(?: 0)?
gpl-3.0 | 2 | 0.95 | general public license | (?:gnu )?general public license{_VER} 3(?: 0)?(?: or(?: at your option)? any later version)?
gpl-2.0 | 2 | 0.95 | general public license | (?:gnu )?general public license{_VER} 2(?: 0)?(?: or(?: at your option)? any later version)?
gpl-1.0 | 2 | 0.95 | general public license | (?:gnu )?general public license{_VER} 1(?: 0)?
gpl-3.0 | 2 | 0.85 | gpl | (?:gnu )?gpl(?: v|v| version)? ?3(?: 0)?
gpl-2.0 | 2 | 0.85 | gpl | (?:gnu )?gpl(?: v|v| version)? ?2(?: 0)?
gpl | 3 | 0.8 | general public license | (?:gnu )?general public license
gpl | 3 | 0.6 | gnu gpl | gnu gpl
lgpl-3.0 | 2 | 0.95 | lesser general public license | (?:gnu )?lesser general public license{_VER} 3(?: 0)?
lgpl-2.1 | 2 | 0.95 | lesser general public license | (?:gnu )?lesser general public license{_VER} 2 1
lgpl-2.0 | 2 | 0.95 | library general public license | (?:gnu )?library general public license{_VER} 2(?: 0)?
lgpl | 3 | 0.85 | lesser general public license | (?:gnu )?lesser general public license
lgpl | 3 | 0.85 | library general public license | (?:gnu )?library general public license
lgpl-3.0 | 2 | 0.85 | lgpl | lgpl(?: v|v| version)? ?3(?: 0)?
lgpl-2.1 | 2 | 0.85 | lgpl | lgpl(?: v|v| version)? ?2 1
lgpl | 3 | 0.7 | gnu lgpl | gnu lgpl
agpl-3.0 | 2 | 0.95 | affero general public license | (?:gnu )?affero general public license{_VER} 3(?: 0)?
agpl | 3 | 0.85 | affero general public license | (?:gnu )?affero general public license
agpl-3.0 | 2 | 0.85 | agpl | agpl(?: v|v| version)? ?3(?: 0)?
gfdl-1.3 | 2 | 0.95 | free documentation license | (?:gnu )?free documentation license{_VER} 1 3
gfdl-1.2 | 2 | 0.95 | free documentation license | (?:gnu )?free documentation license{_VER} 1 2
gfdl-1.1 | 2 | 0.95 | free documentation license | (?:gnu )?free documentation license{_VER} 1 1
gfdl | 3 | 0.85 | free documentation license | (?:gnu )?free documentation license
mpl-2.0 | 1 | 0.98 | source code form is subject | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-2.0 | 2 | 0.95 | mozilla public license | mozilla public license{_VER} 2(?: 0)?
mpl-1.1 | 2 | 0.95 | mozilla public license | mozilla public license{_VER} 1 1
mpl-1.0 | 2 | 0.95 | mozilla public license | mozilla public license{_VER} 1 0
mpl | 3 | 0.8 | mozilla public license | mozilla public license
npl-1.1 | 2 | 0.9 | netscape public license | netscape public license{_VER} 1 1
npl | 3 | 0.8 | netscape public license | netscape public license
epl-2.0 | 2 | 0.95 | eclipse public license | eclipse public license{_VER} 2(?: 0)?
epl-1.0 | 2 | 0.95 | eclipse public license | eclipse public license{_VER} 1(?: 0)?
epl | 3 | 0.8 | eclipse public license | eclipse public license
edl-1.0 | 2 | 0.9 | eclipse distribution license | eclipse distribution license{_VER} 1(?: 0)?
cpl-1.0 | 2 | 0.9 | common public license | common public license{_VER} 1(?: 0)?
cpl | 3 | 0.7 | common public license | common public license
ipl-1.0 | 2 | 0.9 | ibm public license | ibm public license(?:{_VER} 1(?: 0)?)?
cddl-1.1 | 2 | 0.95 | common development and distribution | common development and distribution license{_VER} 1 1
cddl-1.0 | 2 | 0.95 | common development and distribution | common development and distribution license{_VER} 1(?: 0)?
cddl | 3 | 0.8 | common development and distribution | common development and distribution license
eupl-1.2 | 2 | 0.95 | european union public | european union public licen[cs]e{_VER} 1 2
eupl-1.1 | 2 | 0.95 | european union public | european union public licen[cs]e{_VER} 1 1
eupl | 3 | 0.8 | european union public | european union public licen[cs]e
artistic-2.0 | 2 | 0.95 | artistic license | artistic license{_VER} 2(?: 0)?
artistic-1.0 | 2 | 0.9 | artistic license | artistic license{_VER} 1(?: 0)?
artistic | 3 | 0.7 | artistic license | artistic license
bsl-1.0 | 2 | 0.95 | boost software license | boost software license(?:{_VER} 1(?: 0)?)?
ofl-1.1 | 2 | 0.95 | sil open font license | sil open font license(?:{_VER} 1 1)?
ofl-1.1 | 3 | 0.8 | open font license | open font license
ms-pl | 2 | 0.9 | microsoft public license | microsoft public license
ms-rl | 2 | 0.9 | microsoft reciprocal license | microsoft reciprocal license
ncsa | 2 | 0.9 | ncsa open source license | (?:university of illinois )?ncsa open source license
postgresql | 2 | 0.9 | postgresql | postgresql licen[cs]e
openssl | 2 | 0.9 | openssl license | openssl license
openssl | 1 | 0.9 | openssl project | this product includes software developed by the openssl project
ssleay | 2 | 0.9 | ssleay license | original ssleay license
python-2.0 | 2 | 0.9 | python software foundation license | python software foundation license(?:{_VER} 2)?
psf-2.0 | 2 | 0.9 | psf license | psf license(?: agreement)?
php-3.01 | 2 | 0.9 | php license | php license{_VER} 3 01
php-3.0 | 2 | 0.9 | php license | php license{_VER} 3 0
ruby | 2 | 0.8 | ruby license | ruby license
zpl-2.1 | 2 | 0.9 | zope public license | zope public license{_VER} 2 1
zpl-2.0 | 2 | 0.9 | zope public license | zope public license{_VER} 2 0
zpl | 3 | 0.8 | zope public license | zope public license
w3c | 2 | 0.9 | w3c software | w3c software(?: notice)?(?: and)?(?: document)? license
afl-3.0 | 2 | 0.9 | academic free license | academic free license{_VER} 3(?: 0)?
afl-2.1 | 2 | 0.9 | academic free license | academic free license{_VER} 2 1
afl | 3 | 0.8 | academic free license | academic free license
osl-3.0 | 2 | 0.9 | open software license | open software license{_VER} 3(?: 0)?
osl-2.1 | 2 | 0.9 | open software license | open software license{_VER} 2 1
osl | 3 | 0.8 | open software license | open software license
ecl-2.0 | 2 | 0.9 | educational community license | educational community license(?:{_VER} 2(?: 0)?)?
rpl-1.5 | 2 | 0.9 | reciprocal public license | reciprocal public license(?:{_VER} 1 5)?
qpl-1.0 | 2 | 0.9 | q public license | q public license(?:{_VER} 1(?: 0)?)?
sleepycat | 2 | 0.9 | sleepycat | sleepycat(?: software)? license
upl-1.0 | 2 | 0.9 | universal permissive license | universal permissive license(?:{_VER} 1(?: 0)?)?
sspl-1.0 | 2 | 0.9 | server side public license | server side public license(?:{_VER} 1(?: 0)?)?
busl-1.1 | 2 | 0.9 | business source license | business source license(?:{_VER} 1 1)?
elastic-2.0 | 2 | 0.9 | elastic license | elastic license{_VER} 2(?: 0)?
elastic | 3 | 0.7 | elastic license | elastic license
commons-clause | 2 | 0.9 | commons clause | commons clause(?: license)?
odbl-1.0 | 2 | 0.9 | open database license | (?:odc )?open database license(?:{_VER} 1(?: 0)?)?
odc-by-1.0 | 2 | 0.9 | open data commons attribution | open data commons attribution license(?:{_VER} 1(?: 0)?)?
pddl-1.0 | 2 | 0.9 | public domain dedication and license | (?:open data commons )?public domain dedication and license
cdla-permissive-2.0 | 2 | 0.9 | community data license agreement | community data license agreement permissive(?:{_VER} 2(?: 0)?)?
cdla-sharing-1.0 | 2 | 0.9 | community data license agreement | community data license agreement sharing(?:{_VER} 1(?: 0)?)?
ogl-3.0 | 2 | 0.9 | open government licence | open government licence{_VER} 3(?: 0)?
ogl | 3 | 0.8 | open government licence | open government licence
openrail-m | 2 | 0.9 | rail m | (?:creativeml )?open ?rail m(?: license)?
llama-community | 2 | 0.9 | community license agreement | llama(?: [0-9]+)* community license agreement
beerware | 2 | 0.9 | beer ware license | the beer ware license
curl | 3 | 0.7 | curl license | curl license
vim | 3 | 0.7 | vim license | vim license
ijg | 3 | 0.7 | independent jpeg group | independent jpeg group
unicode | 2 | 0.9 | unicode license | unicode license(?: agreement)?(?: data files and software)?
proprietary | 2 | 0.8 | proprietary and confidential | (?:this (?:file|software|document) is )?proprietary and confidential
proprietary | 2 | 0.8 | unauthorized copying | unauthorized copying of this(?: [^ ]+){{0,4}}? is strictly prohibited
proprietary | 3 | 0.6 | no part of this publication | no part of this publication may be reproduced
reserved | 2 | 0.8 | all rights reserved | copyright(?: c)?(?: [0-9]{{4}}){{0,3}}(?: [^ ]+){{0,6}}? all rights reserved
reserved | 3 | 0.7 | all rights reserved | all rights reserved
reserved | 4 | 0.4 | some rights reserved | some rights reserved
commercial | 3 | 0.6 | end user license agreement | end user license agreement
freeware | 4 | 0.4 | freeware | (?:is )?freeware
shareware | 4 | 0.4 | shareware | (?:is )?shareware
unknown | 4 | 0.3 | licensed under | licensed under
unknown | 4 | 0.3 | license terms | license terms
"""

# Parts of Creative Commons names: short form, long form.
CC_KINDS = {
    "by": "attribution",
    "by sa": "attribution sharealike",
    "by nc": "attribution noncommercial",
    "by nd": "attribution noderivatives",
    "by nc sa": "attribution noncommercial sharealike",
    "by nc nd": "attribution noncommercial noderivatives",
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# License identifiers that may follow "SPDX-License-Identifier:" (fixed values).
SPDX_IDS = """0BSD AFL-2.1 AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0
Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1
CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only
GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ICU ISC LGPL-2.0-only LGPL-2.1-only
LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later Libpng LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0
NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0
Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"""


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: str


def all_rules() -> list[Rule]:
    rules = []
    for line in RULES_TEXT.strip().splitlines():
        label, priority, confidence, keyword, pattern = (x.strip() for x in line.split(" | "))
        rules.append(Rule(label, int(priority), float(confidence), keyword, pattern))
    for short, long in CC_KINDS.items():
        name = "cc-" + short.replace(" ", "-")
        # "Share Alike", "Non-Commercial" and "No Derivs" are written in several ways.
        spelled = (long.replace("sharealike", "share ?alike").replace("noncommercial", "non ?commercial")
                   .replace("noderivatives", "no ?deriv(?:ative)?s(?: works)?"))
        for version in CC_VERSIONS:
            label = f"{name}-{version.replace(' ', '.')}"
            rules.append(Rule(label, 2, 0.95, f"cc {short} {version}", f"(?:licensed under )?cc {short} {version}"))
            rules.append(Rule(label, 2, 0.97, "creative commons", f"creative commons {spelled} {version}"))
            rules.append(Rule(label, 2, 0.9, "creativecommons org licenses",
                              f"creativecommons org licenses {short} {version}"))
        rules.append(Rule(name, 3, 0.8, f"cc {short}", f"cc {short}"))
        rules.append(Rule(name, 3, 0.85, "creative commons", f"creative commons {spelled}(?: licen[cs]e)?"))
    for spdx in SPDX_IDS.split():
        words = "".join(c if c.isalnum() else " " for c in spdx.lower())
        rules.append(Rule(spdx.lower(), 1, 0.99, "spdx license identifier", f"spdx license identifier {words}"))
    return rules
