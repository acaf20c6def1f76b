"""Signatures of licences: hand-written patterns over the words of a text, in order of precedence.

A heading in brackets is the word that a text must hold before the patterns below it are tried. Each
rule is ``label level pattern``. Levels, from the weakest: ``mention`` (a bare name), ``name`` (a name
that fixes the version), ``notice`` (a grant, tag or address), ``text`` (a sentence of the licence).

Patterns run over lower-case words with one space between them and match whole words. A space stands
for the border between two words and occurs nowhere else; ``<2.0>`` is a version written as ``2``,
``2.0``, ``v2`` or ``version 2``, with the zero required where the second digit is none.
"""

from __future__ import annotations

import re
from typing import NamedTuple

LEVELS = ("mention", "name", "notice", "text")
#: How sure a detection of each level is.
CONFIDENCE = (0.5, 0.7, 0.9, 1.0)

#: Fixed values of the task: label and phrase of the places that are always reported.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

TABLE = r"""
[mit]
mit mention mit licen[cs]ed?
mit mention mit style licen[cs]e
mit notice (?:licensed|released|distributed|available|provided) under(?: the)?(?: terms of the)? mit
mit notice licen[cs]e mit
mit notice opensource org licenses mit(?: license(?: php)?)?
mit notice spdx license identifier mit
mit-0 name mit 0
mit-0 name mit no attribution
mit-0 notice spdx license identifier mit 0
x11 name mit x11(?: licen[cs]e)?
expat name expat mit licen[cs]e

[expat]
expat mention expat licen[cs]e

[x11]
x11 mention x11 licen[cs]e
x11 notice spdx license identifier x11

[hereby]
mit text permission is hereby granted free of charge to any person obtaining a copy of this software
isc text permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd text permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?(?:without fee )?is hereby granted
bsl-1.0 text permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unicode text permission is hereby granted free of charge to any person obtaining a copy of (?:the )?unicode data files
ofl-1.1 text permission is hereby granted free of charge to any person obtaining a copy of the font software
cc0-1.0 text affirmer hereby overtly fully permanently irrevocably and unconditionally waives
apache-2.0 text each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable

[restriction]
mit text to deal in the software without restriction including without limitation the rights to use copy modify merge publish

[contributor]
ms-pl text each contributor grants you a non exclusive worldwide royalty free copyright license

[anyone]
zlib text permission is granted to anyone to use this software for any purpose including commercial applications

[apache]
apache mention apache licen[cs]ed?
apache mention apache software licen[cs]e
apache mention apache style licen[cs]e
apache-1.0 name apache(?: software)? licen[cs]e <1.0>
apache-1.1 name apache(?: software)? licen[cs]e <1.1>
apache-2.0 name apache(?: software)? licen[cs]e <2.0>
apache-2.0 name apache <2.0>
apache-2.0 name apache 2 0 licen[cs]ed?
apache-2.0 notice (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? apache(?: software)? licen[cs]e <2.0>
apache-2.0 notice (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? apache <2.0>
apache-2.0 notice apache org licenses license 2 0(?: txt| html)?
apache-1.0 notice spdx license identifier apache 1 0
apache-1.1 notice spdx license identifier apache 1 1
apache-2.0 notice spdx license identifier apache 2 0
apache-1.1 text this product includes software developed by the apache software foundation

[asl]
apache-2.0 name asl <2.0>

[compliance]
apache-2.0 text you may not use this file except in compliance with the license

[conditions]
apache-2.0 text without warranties or conditions of any kind either express or implied
bsd text redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd text redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd text redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met

[public]
gpl mention general public licen[cs]e
gpl mention gnu public licen[cs]e
gpl name gnu general public licen[cs]e
gpl-1.0 name (?:gnu )?general public licen[cs]e <1.0>
gpl-2.0 name (?:gnu )?general public licen[cs]e <2.0>
gpl-3.0 name (?:gnu )?general public licen[cs]e <3.0>
gpl-2.0-or-later name (?:gnu )?general public licen[cs]e <2.0> or(?: at your option)?(?: any)? later(?: version)?
gpl-3.0-or-later name (?:gnu )?general public licen[cs]e <3.0> or(?: at your option)?(?: any)? later(?: version)?
gpl-2.0 notice (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)?(?: gnu)? general public licen[cs]e <2.0>
gpl-3.0 notice (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)?(?: gnu)? general public licen[cs]e <3.0>
lgpl mention lesser general public licen[cs]e
lgpl mention library general public licen[cs]e
lgpl name gnu lesser general public licen[cs]e
lgpl name gnu library general public licen[cs]e
lgpl-2.0 name (?:gnu )?library general public licen[cs]e <2.0>
lgpl-2.1 name (?:gnu )?lesser general public licen[cs]e <2.1>
lgpl-3.0 name (?:gnu )?lesser general public licen[cs]e <3.0>
lgpl-2.1 notice (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)?(?: gnu)? lesser general public licen[cs]e <2.1>
lgpl-3.0 notice (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)?(?: gnu)? lesser general public licen[cs]e <3.0>
agpl mention affero general public licen[cs]e
agpl name gnu affero general public licen[cs]e
agpl-1.0 name (?:gnu )?affero general public licen[cs]e <1.0>
agpl-3.0 name (?:gnu )?affero general public licen[cs]e <3.0>
agpl-3.0 notice (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)?(?: gnu)? affero general public licen[cs]e <3.0>
mpl mention mozilla public licen[cs]e
mpl-1.0 name mozilla public licen[cs]e <1.0>
mpl-1.1 name mozilla public licen[cs]e <1.1>
mpl-2.0 name mozilla public licen[cs]e <2.0>
mpl-1.1 text the contents of this file are subject to the mozilla public license <1.1>
mpl-2.0 text this source code form is subject to the terms of the mozilla public license v 2 0
epl mention eclipse public licen[cs]e
epl-1.0 name eclipse public licen[cs]e <1.0>
epl-2.0 name eclipse public licen[cs]e <2.0>
epl-1.0 text this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 text this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
eupl mention european union public licen[cs]e
eupl-1.1 name european union public licen[cs]e <1.1>
eupl-1.2 name european union public licen[cs]e <1.2>
cpl-1.0 mention common public licen[cs]e
cpl-1.0 name common public licen[cs]e <1.0>
ms-pl mention microsoft public licen[cs]e
wtfpl name do what the fuck you want to public licen[cs]e
lppl mention latex project public licen[cs]e
lppl-1.3c name latex project public licen[cs]e <1.3>
apsl mention apple public source licen[cs]e
apsl-2.0 name apple public source licen[cs]e <2.0>
npl mention netscape public licen[cs]e
qpl mention q public licen[cs]e
rpl mention reciprocal public licen[cs]e
spl mention sun public licen[cs]e
sspl-1.0 mention server side public licen[cs]e
sspl-1.0 name server side public licen[cs]e <1.0>
zpl mention zope public licen[cs]e
zpl-2.1 name zope public licen[cs]e <2.1>
ipl-1.0 mention ibm public licen[cs]e
cecill mention french free software public licen[cs]e
public-domain mention (?:in|into|to) the public domain
public-domain name public domain dedication
public-domain notice (?:released|placed|dedicated) (?:in|into|to) the public domain
unlicense text this is free and unencumbered software released into the public domain
cc-by-4.0 name attribution <4.0> international public licen[cs]e
cc-by-sa-4.0 name attribution sharealike <4.0> international public licen[cs]e
cc-by-nc-4.0 name attribution noncommercial <4.0> international public licen[cs]e
odbl-1.0 text public domain dedication and license open database license

[gpl]
gpl mention gpl
gpl mention gpl licen[cs]ed?
gpl mention gnu gpl
gpl-1.0 name (?:gnu )?gpl <1.0>
gpl-2.0 name (?:gnu )?gpl <2.0>
gpl-3.0 name (?:gnu )?gpl <3.0>
gpl-2.0-or-later name (?:gnu )?gpl <2.0> or(?: any)? later
gpl-3.0-or-later name (?:gnu )?gpl <3.0> or(?: any)? later
gpl-2.0-or-later name gpl 2 0 plus
gpl-3.0-or-later name gpl 3 0 plus
gpl-1.0 notice spdx license identifier gpl 1 0(?: only)?
gpl-2.0 notice spdx license identifier gpl 2 0(?: only)?
gpl-3.0 notice spdx license identifier gpl 3 0(?: only)?
gpl-1.0-or-later notice spdx license identifier gpl 1 0 or later
gpl-2.0-or-later notice spdx license identifier gpl 2 0 or later
gpl-3.0-or-later notice spdx license identifier gpl 3 0 or later
gpl-2.0-with-classpath-exception notice spdx license identifier gpl 2 0(?: only)? with classpath exception 2 0
gpl-3.0-with-gcc-exception notice spdx license identifier gpl 3 0(?: or later)? with gcc exception 3 1

[gplv2]
gpl-2.0 name gplv2(?: only)?
gpl-2.0-or-later name gplv2 or(?: any)? later

[gplv3]
gpl-3.0 name gplv3(?: only)?
gpl-3.0-or-later name gplv3 or(?: any)? later

[lgpl]
lgpl mention lgpl
lgpl mention gnu lgpl
lgpl-2.0 name (?:gnu )?lgpl <2.0>
lgpl-2.1 name (?:gnu )?lgpl <2.1>
lgpl-3.0 name (?:gnu )?lgpl <3.0>
lgpl-2.0 notice spdx license identifier lgpl 2 0(?: only)?
lgpl-2.1 notice spdx license identifier lgpl 2 1(?: only)?
lgpl-3.0 notice spdx license identifier lgpl 3 0(?: only)?
lgpl-2.0-or-later notice spdx license identifier lgpl 2 0 or later
lgpl-2.1-or-later notice spdx license identifier lgpl 2 1 or later
lgpl-3.0-or-later notice spdx license identifier lgpl 3 0 or later

[lgplv3]
lgpl-3.0 name lgplv3

[agpl]
agpl mention agpl
agpl-3.0 name (?:gnu )?agpl <3.0>
agpl-1.0 notice spdx license identifier agpl 1 0(?: only)?
agpl-3.0 notice spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later notice spdx license identifier agpl 3 0 or later

[agplv3]
agpl-3.0 name agplv3

[gnu]
gpl notice gnu org licenses gpl(?: html| txt)?
gpl-2.0 notice gnu org licenses(?: old licenses)? gpl 2 0(?: html| txt)?
gpl-3.0 notice gnu org licenses gpl 3 0(?: html| txt)?
lgpl notice gnu org licenses lgpl(?: html| txt)?
lgpl-2.1 notice gnu org licenses(?: old licenses)? lgpl 2 1(?: html| txt)?
lgpl-3.0 notice gnu org licenses lgpl 3 0(?: html| txt)?
agpl-3.0 notice gnu org licenses agpl(?: 3 0)?(?: html| txt)?
gfdl notice gnu org licenses fdl(?: html| txt)?
gfdl mention gnu free documentation licen[cs]e
gfdl-1.1 name gnu free documentation licen[cs]e <1.1>
gfdl-1.2 name gnu free documentation licen[cs]e <1.2>
gfdl-1.3 name gnu free documentation licen[cs]e <1.3>
gpl text you should have received a copy of the gnu general public license along with this program
lgpl text you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)
agpl text you should have received a copy of the gnu affero general public license along with this program
gpl text this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl text this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl text this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license

[gfdl]
gfdl mention gfdl
gfdl-1.1 notice spdx license identifier gfdl 1 1(?: only| or later)?
gfdl-1.2 notice spdx license identifier gfdl 1 2(?: only| or later)?
gfdl-1.3 notice spdx license identifier gfdl 1 3(?: only| or later)?

[fitness]
gpl text without even the implied warranty of merchantability or fitness for a particular purpose
warranty-disclaimer text including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
warranty-disclaimer text including but not limited to the implied warranties of merchantability and fitness for a particular purpose

[bsd]
bsd mention bsd licen[cs]ed?
bsd mention bsd style licen[cs]e
bsd-2-clause name (?:2|two) clause bsd(?: licen[cs]e)?
bsd-3-clause name (?:3|three) clause bsd(?: licen[cs]e)?
bsd-4-clause name (?:4|four) clause bsd(?: licen[cs]e)?
bsd-2-clause name bsd (?:2|two) clause(?: licen[cs]e)?
bsd-3-clause name bsd (?:3|three) clause(?: licen[cs]e)?
bsd-4-clause name bsd (?:4|four) clause(?: licen[cs]e)?
0bsd name zero clause bsd(?: licen[cs]e)?
bsd-3-clause name (?:new|modified|revised) bsd licen[cs]e
bsd-2-clause name (?:simplified|freebsd) bsd licen[cs]e
bsd-4-clause name (?:original|old) bsd licen[cs]e
bsd notice (?:licensed|released|distributed|available) under(?: the)?(?: terms of the)? bsd
bsd-2-clause notice spdx license identifier bsd 2 clause
bsd-3-clause notice spdx license identifier bsd 3 clause
bsd-4-clause notice spdx license identifier bsd 4 clause
bsd-2-clause-patent notice spdx license identifier bsd 2 clause patent
bsd-3-clause-clear notice spdx license identifier bsd 3 clause clear

[0bsd]
0bsd name 0bsd
0bsd notice spdx license identifier 0bsd

[endorse]
bsd-3-clause text neither the name of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products derived from this software

[advertising]
bsd-4-clause text all advertising materials mentioning features or use of this software must display the following acknowledgement

[isc]
isc mention isc licen[cs]ed?
isc notice spdx license identifier isc
isc notice opensource org licenses isc

[mpl]
mpl mention mpl
mpl-1.1 name mpl <1.1>
mpl-2.0 name mpl <2.0>
mpl-1.0 notice spdx license identifier mpl 1 0
mpl-1.1 notice spdx license identifier mpl 1 1
mpl-2.0 notice spdx license identifier mpl 2 0

[mozilla]
mpl notice mozilla org mpl
mpl-1.1 notice mozilla org mpl 1 1
mpl-2.0 notice mozilla org mpl 2 0

[epl]
epl-1.0 name epl <1.0>
epl-2.0 name epl <2.0>
epl-1.0 notice spdx license identifier epl 1 0
epl-2.0 notice spdx license identifier epl 2 0

[eclipse]
edl-1.0 mention eclipse distribution licen[cs]e
epl-1.0 notice eclipse org legal epl v10(?: html)?
epl-2.0 notice eclipse org legal epl 2 0(?: html)?

[cddl]
cddl mention cddl
cddl-1.0 name cddl <1.0>
cddl-1.1 name cddl <1.1>
cddl-1.0 notice spdx license identifier cddl 1 0
cddl-1.1 notice spdx license identifier cddl 1 1

[common]
cddl mention common development and distribution licen[cs]e
cddl-1.0 name common development and distribution licen[cs]e <1.0>

[eupl]
eupl-1.2 name eupl <1.2>
eupl-1.1 notice spdx license identifier eupl 1 1
eupl-1.2 notice spdx license identifier eupl 1 2

[creative]
cc mention creative commons
cc mention creative commons licen[cs]e
cc-by name creative commons attribution(?: licen[cs]e)?
cc-by-sa name creative commons attribution (?:share alike|sharealike)(?: licen[cs]e)?
cc-by-nc name creative commons attribution (?:non commercial|noncommercial)(?: licen[cs]e)?
cc-by-nd name creative commons attribution (?:no derivatives|no derivative works|noderivatives|noderivs)(?: licen[cs]e)?
cc-by-3.0 name creative commons attribution <3.0>
cc-by-4.0 name creative commons attribution <4.0>
cc-by-sa-3.0 name creative commons attribution sharealike <3.0>
cc-by-sa-4.0 name creative commons attribution sharealike <4.0>
cc-by-nc-4.0 name creative commons attribution noncommercial <4.0>
cc-by-nc-sa-4.0 name creative commons attribution noncommercial sharealike <4.0>
cc-by-nc-nd-4.0 name creative commons attribution noncommercial noderivatives <4.0>
cc0-1.0 name creative commons zero

[creativecommons]
cc notice creativecommons org licenses
cc-by-2.0 notice creativecommons org licenses by 2 0
cc-by-3.0 notice creativecommons org licenses by 3 0
cc-by-4.0 notice creativecommons org licenses by 4 0
cc-by-sa-3.0 notice creativecommons org licenses by sa 3 0
cc-by-sa-4.0 notice creativecommons org licenses by sa 4 0
cc-by-nc-3.0 notice creativecommons org licenses by nc 3 0
cc-by-nc-4.0 notice creativecommons org licenses by nc 4 0
cc-by-nd-4.0 notice creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 notice creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 notice creativecommons org licenses by nc nd 4 0
cc0-1.0 notice creativecommons org publicdomain zero 1 0
public-domain notice creativecommons org publicdomain mark 1 0

[cc]
cc-by name cc by
cc-by-sa name cc by sa
cc-by-nc name cc by nc
cc-by-nd name cc by nd
cc-by-nc-sa name cc by nc sa
cc-by-nc-nd name cc by nc nd
cc-by-2.0 name cc by 2 0
cc-by-3.0 name cc by 3 0
cc-by-4.0 name cc by 4 0
cc-by-sa-2.0 name cc by sa 2 0
cc-by-sa-3.0 name cc by sa 3 0
cc-by-sa-4.0 name cc by sa 4 0
cc-by-nc-2.0 name cc by nc 2 0
cc-by-nc-3.0 name cc by nc 3 0
cc-by-nc-4.0 name cc by nc 4 0
cc-by-nd-3.0 name cc by nd 3 0
cc-by-nd-4.0 name cc by nd 4 0
cc-by-nc-sa-3.0 name cc by nc sa 3 0
cc-by-nc-sa-4.0 name cc by nc sa 4 0
cc-by-nc-nd-3.0 name cc by nc nd 3 0
cc-by-nc-nd-4.0 name cc by nc nd 4 0
cc-by-4.0 notice licensed under(?: a| the)? cc by 4 0
cc-by-sa-4.0 notice licensed under(?: a| the)? cc by sa 4 0
cc-by-nc-4.0 notice licensed under(?: a| the)? cc by nc 4 0
cc-by-nc-sa-4.0 notice licensed under(?: a| the)? cc by nc sa 4 0
cc-by-nc-nd-4.0 notice licensed under(?: a| the)? cc by nc nd 4 0
cc-by-4.0 notice spdx license identifier cc by 4 0
cc-by-sa-4.0 notice spdx license identifier cc by sa 4 0

[cc0]
cc0-1.0 name cc0(?: 1 0)?
cc0-1.0 notice spdx license identifier cc0 1 0

[unlicense]
unlicense mention unlicense
unlicense notice unlicense org
unlicense notice spdx license identifier unlicense

[wtfpl]
wtfpl mention wtfpl
wtfpl notice spdx license identifier wtfpl

[zlib]
zlib mention zlib licen[cs]e
zlib name zlib libpng licen[cs]e
zlib notice spdx license identifier zlib

[boost]
bsl-1.0 mention boost software licen[cs]e
bsl-1.0 name boost software licen[cs]e <1.0>
bsl-1.0 notice boost org license 1 0(?: txt)?

[bsl]
bsl-1.0 notice spdx license identifier bsl 1 0

[business]
busl-1.1 mention business source licen[cs]e
busl-1.1 name business source licen[cs]e <1.1>

[busl]
busl-1.1 notice spdx license identifier busl 1 1

[elastic]
elastic mention elastic licen[cs]e
elastic-2.0 name elastic licen[cs]e <2.0>

[clause]
commons-clause mention commons clause license condition

[artistic]
artistic mention artistic licen[cs]e
artistic-1.0 name artistic licen[cs]e <1.0>
artistic-2.0 name artistic licen[cs]e <2.0>
artistic-2.0 notice spdx license identifier artistic 2 0

[academic]
afl mention academic free licen[cs]e
afl-3.0 name academic free licen[cs]e <3.0>

[educational]
ecl-2.0 name educational community licen[cs]e <2.0>
ecl mention educational community licen[cs]e

[open]
osl mention open software licen[cs]e
osl-3.0 name open software licen[cs]e <3.0>
ofl mention open font licen[cs]e
ofl-1.1 name open font licen[cs]e <1.1>
odbl mention open database licen[cs]e
odbl-1.0 name open database licen[cs]e <1.0>
odc-by mention open data commons attribution licen[cs]e
ogl mention open government licen[cs]e
ogl-3.0 name open government licen[cs]e <3.0>

[ofl]
ofl-1.1 name sil ofl(?: <1.1>)?
ofl-1.1 notice spdx license identifier ofl 1 1

[sil]
ofl mention sil open font licen[cs]e
ofl-1.1 notice scripts sil org ofl

[odbl]
odbl-1.0 name odbl(?: <1.0>)?

[openssl]
openssl mention openssl licen[cs]e
openssl text this product includes software developed by the openssl project

[python]
psf mention python software foundation licen[cs]e
psf-2.0 name python software foundation licen[cs]e <2.0>
psf mention python licen[cs]e

[psf]
psf mention psf licen[cs]e
psf-2.0 notice spdx license identifier psf 2 0

[php]
php mention php licen[cs]e
php-3.01 name php licen[cs]e <3.01>

[ruby]
ruby mention ruby licen[cs]e

[postgresql]
postgresql mention postgresql licen[cs]e
postgresql notice spdx license identifier postgresql

[ncsa]
ncsa mention ncsa(?: open source)? licen[cs]e
ncsa notice spdx license identifier ncsa

[microsoft]
ms-rl mention microsoft reciprocal licen[cs]e

[cecill]
cecill mention cecill
cecill-2.1 name cecill <2.1>

[mulan]
mulanpsl-2.0 mention mulan permissive software licen[cs]e

[blue]
blueoak-1.0.0 mention blue oak model licen[cs]e

[polyform]
polyform mention polyform (?:noncommercial|small business|shield|strict) licen[cs]e

[openrail]
openrail mention openrail
openrail-m name openrail m

[llama]
llama mention llama (?:2 |3 )?community licen[cs]e

[reserved]
all-rights-reserved notice all rights reserved

[proprietary]
proprietary mention proprietary and confidential
proprietary notice proprietary licen[cs]e

[reproduced]
all-rights-reserved text no part of this (?:publication|book|work) may be reproduced
"""


class Rule(NamedTuple):
    """``no`` is the place in the order; ``pattern`` is ready for texts as ``spread`` writes them."""

    no: int
    label: str
    level: int
    keyword: str
    pattern: str
    base: bool


def spread(pattern: str) -> str:
    """A pattern over words for texts in which each word has a space of its own on either side, so
    that neighbouring matches share none: `` mit  license ``."""

    def version(found: re.Match) -> str:
        major, minor = found.group(1).split(".")
        return f"(?: version)? v?{major}" + ("(?: 0)?" if minor == "0" else f" {minor}")

    return " " + re.sub(r" <([\d.]+)>", version, pattern).replace(" ", "  ") + " "


def _rules() -> list[Rule]:
    keyword, found = "", [(phrase.split()[0], label, 0, phrase, True) for label, phrase in BASE.items()]
    for line in filter(None, TABLE.splitlines()):
        if line.startswith("["):
            keyword = line.strip("[]")
        else:
            label, level, pattern = line.split(" ", 2)
            found.append((keyword, label, LEVELS.index(level), pattern, False))
    return [
        Rule(no, label, level, f" {keyword} ", spread(pattern), base)
        for no, (keyword, label, level, pattern, base) in enumerate(found)
    ]


RULES = _rules()
