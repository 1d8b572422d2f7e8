"""License scans: ordered signature rules behind a keyword gate, overlaps resolved by containment.

A text is reduced to its words (ASCII capitals lower-cased, everything but digits, letters and
non-ASCII characters a separator), so a pattern is a run of words whatever stood between them. Rules
come in tiers: SPDX tags, sentences of license texts, addresses, grants ("released under ..."),
titles, weak hints. A rule is tried only on texts that hold all its gate words. Detections are then
taken by tier, longer ones first: one that lies inside a kept one is dropped, while partial overlaps
stay. Places of the fixed phrases are reported always, suppressed or not, as rule ``base``.

Texts are read whole and in slices, so a text needs some three times its bytes.

Defined results: a null or empty text has no words and no detections, score zero; rows that repeat a
doc_id give one result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimdex.llm.common import session

#: phrases reported wherever their words stand, and their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_SCORE = 0.8
#: scores by tier, in order of priority
TIERS = {"tag": 0.99, "text": 0.95, "url": 0.9, "grant": 0.85, "title": 0.6, "hint": 0.3}
#: bytes of a text that are cut into words at a time
SLICE = 1 << 20

#: Licenses: label | gate words | name | address or addresses. ``<2.1>`` is a version with or without
#: "version" or "v" before it; words stand as the scan sees them, without marks.
LICENSES = r"""
mit | mit | (?:the )?mit(?: open source| style| x11| expat)? licen[sc]e | opensource org licenses? mit
mit | mit lizenz | mit lizenz |
mit | mit licence | licence mit |
mit | mit licencia | licencia mit |
mit | expat | expat licen[sc]e |
mit-0 | mit attribution | mit no attribution(?: license)? | opensource org licenses? mit 0
x11 | x11 | x11(?: style)? licen[sc]e |
apache-2 | apache | apache(?: software)?(?: licen[sc]e)? <2> | apache org licenses license 2 0 ; opensource org licenses? apache 2 0
apache-2 | apache lizenz | apache lizenz <2> |
apache-1.1 | apache | apache(?: software)? licen[sc]e <1.1> | apache org licenses license 1 1
apache-1 | apache | apache(?: software)? licen[sc]e <1> | apache org licenses license 1 0
agpl-3 | affero | (?:gnu )?affero (?:general public licen[sc]e|gpl)(?: agpl)?(?: <3>)? | gnu org licenses agpl 3 0 ; gnu org licenses agpl
agpl-3 | agpl | agpl <3> |
agpl-3 | agplv3 | (?:gnu )?agplv3 |
agpl-1 | affero | affero general public licen[sc]e <1> |
lgpl-3 | lesser | (?:gnu )?lesser general public licen[sc]e(?: lgpl)? <3> | gnu org licenses lgpl 3 0
lgpl-3 | lgpl | (?:gnu )?lgpl <3> |
lgpl-3 | lgplv3 | (?:gnu )?lgplv3 |
lgpl-2.1 | lesser | (?:gnu )?lesser general public licen[sc]e(?: lgpl)? <2.1> | gnu org licenses lgpl 2 1 ; gnu org licenses old licenses lgpl 2 1
lgpl-2.1 | lgpl | (?:gnu )?lgpl <2.1> |
lgpl-2 | library general | (?:gnu )?library general public licen[sc]e(?: lgpl)?(?: <2>)? | gnu org licenses old licenses lgpl 2 0
lgpl | lesser | (?:gnu )?lesser general public licen[sc]e | gnu org licenses lgpl
lgpl | lgpl | (?:gnu )?lgpl(?: licen[sc]e)? |
gpl-3 | general public | (?:gnu )?general public licen[sc]e(?: gpl)? <3> | gnu org licenses gpl 3 0
gpl-3 | gpl | (?:gnu )?gpl <3> |
gpl-3 | gplv3 | (?:gnu )?gplv3 |
gpl-2 | general public | (?:gnu )?general public licen[sc]e(?: gpl)? <2> | gnu org licenses gpl 2 0 ; gnu org licenses old licenses gpl 2 0
gpl-2 | gpl | (?:gnu )?gpl <2> |
gpl-2 | gplv2 | (?:gnu )?gplv2 |
gpl-1 | general public | (?:gnu )?general public licen[sc]e(?: gpl)? <1> |
gpl | gnu | gnu general public licen[sc]e | gnu org licenses gpl ; gnu org copyleft gpl
gpl | gpl | (?:gnu )?gpl licen[sc]e |
gfdl-1.3 | documentation free | (?:gnu )?free documentation licen[sc]e <1.3> | gnu org licenses fdl 1 3
gfdl-1.2 | documentation free | (?:gnu )?free documentation licen[sc]e <1.2> | gnu org licenses old licenses fdl 1 2
gfdl | documentation gnu | gnu free documentation licen[sc]e | gnu org licenses fdl
gfdl | gfdl | gfdl(?: licen[sc]e)? |
bsd-2-clause | bsd | (?:simplified|freebsd|2 clause|two clause) bsd(?: style)?(?: licen[sc]e)? | opensource org licenses? bsd 2 clause
bsd-2-clause | bsd | bsd (?:2|two) clause(?: licen[sc]e)? |
bsd-3-clause | bsd | (?:new|revised|modified|3 clause|three clause) bsd(?: style)?(?: licen[sc]e)? | opensource org licenses? bsd 3 clause
bsd-3-clause | bsd | bsd (?:3|three) clause(?: licen[sc]e)? |
bsd-4-clause | bsd | (?:original|old|4 clause|four clause) bsd(?: style)?(?: licen[sc]e)? |
bsd-4-clause | bsd | bsd (?:4|four) clause(?: licen[sc]e)? |
0bsd | 0bsd | 0bsd(?: licen[sc]e)? | opensource org licenses? 0bsd
0bsd | bsd | (?:zero|0) clause bsd(?: licen[sc]e)? |
bsd | bsd | bsd(?: style)? licen[sc]e |
isc | isc | isc licen[sc]e | opensource org licenses? isc
mpl-2 | mozilla | mozilla public licen[sc]e(?: mpl)? <2> | mozilla org mpl 2 0 ; mozilla org en us mpl 2 0
mpl-2 | mpl | mpl <2> |
mpl-1.1 | mozilla | mozilla public licen[sc]e(?: mpl)? <1.1> | mozilla org mpl 1 1
mpl-1 | mozilla | mozilla public licen[sc]e(?: mpl)? <1> |
mpl | mozilla | mozilla public licen[sc]e | mozilla org mpl
npl-1.1 | netscape | netscape public licen[sc]e(?: <1.1>)? |
epl-2 | eclipse | eclipse public licen[sc]e(?: epl)? <2> | eclipse org legal epl 2 0 ; eclipse org legal epl v20
epl-1 | eclipse | eclipse public licen[sc]e(?: epl)? <1> | eclipse org legal epl v10
epl | eclipse | eclipse public licen[sc]e |
edl-1 | eclipse | eclipse distribution licen[sc]e(?: <1>)? | eclipse org org documents edl v10
cpl-1 | common | common public licen[sc]e(?: <1>)? |
ipl-1 | ibm | ibm public licen[sc]e(?: <1>)? |
cddl-1.1 | cddl | cddl <1.1> |
cddl-1 | cddl | cddl(?: <1>)?(?: licen[sc]e)? | opensource org licenses? cddl 1 0
cddl-1 | common development distribution | common development and distribution licen[sc]e(?: cddl)?(?: <1>)? |
eupl-1.2 | eupl | eupl <1.2> | joinup ec europa eu software page eupl
eupl-1.2 | european union | european union public licen[sc]e(?: eupl)? <1.2> |
eupl-1.1 | european union | european union public licen[sc]e(?: eupl)? <1.1> |
eupl | european union | european union public licen[sc]e |
cecill-2.1 | cecill | cecill(?: free software)?(?: licen[sc]e)? <2.1> | cecill info licences licence cecill v2 1
cecill-b | cecill | cecill b(?: licen[sc]e)? | cecill info licences licence cecill b
cecill-c | cecill | cecill c(?: licen[sc]e)? | cecill info licences licence cecill c
cecill | cecill | cecill(?: licen[sc]e)? |
artistic-2 | artistic | artistic licen[sc]e <2> | perlfoundation org artistic license 2 0
artistic-1 | artistic | artistic licen[sc]e <1> |
artistic | artistic | (?:perl )?artistic licen[sc]e |
zlib | zlib | zlib(?: libpng)? licen[sc]e | opensource org licenses? zlib
libpng | libpng | libpng licen[sc]e |
boost-1 | boost | boost software licen[sc]e(?: <1>)? | boost org license 1 0 ; boost org users license
unlicense | unlicense | (?:the )?unlicense | unlicense org
wtfpl | wtfpl | wtfpl(?: <2>)? | wtfpl net
beerware | beerware | beerware licen[sc]e |
beerware | beer ware | beer ware licen[sc]e |
psf-2 | python | python software foundation licen[sc]e(?: <2>)? | docs python org license ; python org psf license
psf-2 | psf | psf licen[sc]e(?: <2>)? |
postgresql | postgresql | postgresql licen[sc]e | opensource org licenses? postgresql
openssl | openssl | openssl licen[sc]e |
php-3.01 | php | php licen[sc]e(?: <3.01>)? | php net license
ruby | ruby | ruby(?: s)? licen[sc]e |
vim | vim | vim licen[sc]e |
tcl | tcl | tcl(?: tk)? licen[sc]e |
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e | opensource org licenses? ncsa
w3c | w3c | w3c(?: software)?(?: notice and)? licen[sc]e | w3 org consortium legal copyright software
zpl-2.1 | zope | zope public licen[sc]e(?: zpl)?(?: <2.1>)? |
upl-1 | universal permissive | universal permissive licen[sc]e(?: upl)?(?: <1>)? | oss oracle com licenses upl
afl-3 | academic | academic free licen[sc]e(?: afl)?(?: <3>)? | opensource org licenses? afl 3 0
osl-3 | open software | open software licen[sc]e(?: osl)? <3> | opensource org licenses? osl 3 0
nposl-3 | non profit | non profit open software licen[sc]e(?: <3>)? |
ecl-2 | educational community | educational community licen[sc]e(?: ecl)?(?: <2>)? | opensource org licenses? ecl 2 0
ms-pl | microsoft | microsoft public licen[sc]e(?: ms pl)? | opensource org licenses? ms pl
ms-rl | microsoft | microsoft reciprocal licen[sc]e(?: ms rl)? | opensource org licenses? ms rl
apsl-2 | apple | apple public source licen[sc]e(?: apsl)?(?: <2>)? | opensource apple com apsl
qpl-1 | q public | q public licen[sc]e(?: qpl)?(?: <1>)? |
sleepycat | sleepycat | sleepycat licen[sc]e |
lppl-1.3c | latex | latex project public licen[sc]e(?: lppl)?(?: (?:version )?1 3c?)? | latex project org lppl
ofl-1.1 | sil | sil open font licen[sc]e(?: ofl)?(?: <1.1>)? | scripts sil org ofl ; openfontlicense org
ofl-1.1 | ofl | ofl <1.1> |
bitstream-vera | bitstream | bitstream vera(?: fonts?)? licen[sc]e |
ubuntu-font-1 | ubuntu | ubuntu font licen[sc]e(?: <1>)? |
mulan-psl-2 | mulan | mulan (?:psl|permissive software licen[sc]e)(?: <2>)? | license coscl org cn mulanpsl2
blueoak-1 | oak | blue oak model licen[sc]e(?: <1>)? | blueoakcouncil org license 1 0 0
rpl-1.5 | reciprocal | reciprocal public licen[sc]e(?: rpl)?(?: <1.5>)? |
watcom-1 | watcom | sybase open watcom public licen[sc]e(?: <1>)? |
intel | intel | intel open source licen[sc]e |
lucent-1.02 | lucent | lucent public licen[sc]e(?: <1.02>)? |
nasa-1.3 | nasa | nasa open source agreement(?: <1.3>)? |
nokia | nokia | nokia open source licen[sc]e |
realnetworks-1 | realnetworks | realnetworks public source licen[sc]e(?: <1>)? |
ricoh-1 | ricoh | ricoh source code public licen[sc]e(?: <1>)? |
sun-public-1 | sun | sun public licen[sc]e(?: <1>)? |
vovida-1 | vovida | vovida software licen[sc]e(?: <1>)? |
xnet | x net | x net licen[sc]e |
eiffel-2 | eiffel | eiffel forum licen[sc]e(?: <2>)? |
fair | fair | fair licen[sc]e |
entessa | entessa | entessa public licen[sc]e(?: <1>)? |
frameworx-1 | frameworx | frameworx(?: open)? licen[sc]e(?: <1>)? |
motosoto | motosoto | motosoto open source licen[sc]e |
ogl-3 | government | open government licen[sc]e(?: <3>)? | nationalarchives gov uk doc open government licence
etalab-2 | etalab | (?:licence ouverte )?etalab(?: open licen[sc]e)? <2> | etalab gouv fr licence ouverte
dl-de-by-2 | deutschland | datenlizenz deutschland namensnennung(?: <2>)? | govdata de dl de by 2 0
odbl-1 | odbl | odbl(?: <1>)?(?: licen[sc]e)? | opendatacommons org licenses odbl
odbl-1 | database | open (?:data commons open )?database licen[sc]e(?: odbl)?(?: <1>)? |
odc-by-1 | commons attribution | open data commons attribution licen[sc]e(?: <1>)? | opendatacommons org licenses by
pddl-1 | dedication | (?:odc )?public domain dedication and licen[sc]e(?: pddl)?(?: <1>)? | opendatacommons org licenses pddl
cdla-permissive-2 | community | community data licen[sc]e agreement permissive(?: <2>)? | cdla dev permissive 2 0
cdla-sharing-1 | community | community data licen[sc]e agreement sharing(?: <1>)? | cdla dev sharing 1 0
c-uda-1 | computational | computational use of data agreement(?: <1>)? |
cc-by-nc-nd | cc nc nd | cc by nc nd(?: <4>| <3>| <2.5>| <2>)? | creativecommons org licenses by nc nd
cc-by-nc-sa | cc nc sa | cc by nc sa(?: <4>| <3>| <2.5>| <2>)? | creativecommons org licenses by nc sa
cc-by-nc | cc nc | cc by nc(?: <4>| <3>| <2.5>| <2>)? | creativecommons org licenses by nc
cc-by-nd | cc nd | cc by nd(?: <4>| <3>| <2.5>| <2>)? | creativecommons org licenses by nd
cc-by-sa | cc sa | cc by sa(?: <4>| <3>| <2.5>| <2>)? | creativecommons org licenses by sa
cc-by | cc by | cc by(?: <4>| <3>| <2.5>| <2>| licen[sc]e) | creativecommons org licenses by
cc0-1 | cc0 | cc0(?: <1>)?(?: universal)? | creativecommons org publicdomain zero
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: <4>| <3>)?(?: international| unported)? |
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike(?: <4>| <3>)?(?: international| unported)? |
cc-by-nc | creative commons | creative commons attribution non ?commercial(?: <4>| <3>)?(?: international| unported)? |
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: <4>| <3>)?(?: international| unported)? |
cc-by-sa | creative commons | creative commons attribution share ?alike(?: <4>| <3>)?(?: international| unported)? |
cc-by | creative commons | creative commons attribution(?: <4>| <3>)?(?: international| unported)? |
cc | creative commons | creative commons licen[sc]e | creativecommons org licenses
cc | creative commons | licen(?:ce|cia) creative commons |
cc | creative commons | creative commons lizenz |
sspl-1 | server side | server side public licen[sc]e(?: sspl)?(?: <1>)? | mongodb com licensing server side public license
busl-1.1 | business | business source licen[sc]e(?: <1.1>)? | mariadb com bsl11
elastic-2 | elastic | elastic licen[sc]e(?: <2>)? | elastic co licensing elastic license
commons-clause | clause | commons clause(?: licen[sc]e)? condition(?: <1>)? | commonsclause com
polyform-nc-1 | polyform | polyform noncommercial licen[sc]e(?: <1>)? | polyformproject org licenses noncommercial
polyform-sb-1 | polyform | polyform small business licen[sc]e(?: <1>)? | polyformproject org licenses small business
hippocratic-2.1 | hippocratic | hippocratic licen[sc]e(?: <2.1>| <3>)? | firstdonoharm dev
confluent | confluent | confluent community licen[sc]e(?: agreement)? |
timescale | timescale | timescale licen[sc]e(?: agreement)? |
parity-7 | parity | parity public licen[sc]e(?: <7>)? |
prosperity-3 | prosperity | prosperity public licen[sc]e(?: <3>)? |
openrail-m | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: (?:m|pp))?(?: licen[sc]e)? |
bloom-rail-1 | rail | bigscience (?:bloom )?rail licen[sc]e(?: <1>)? | bigscience huggingface co blog the bigscience rail license
nc-government | non commercial | non commercial government licen[sc]e |
"""

#: Sentences of license texts: label | gate words | pattern
TEXTS = r"""
mit | granted obtaining associated | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
boost-1 | granted organization accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
isc | granted fee | permission to use copy modify (?:and or|and|or) distribute this software for any purpose with or without fee is hereby granted
apache-2 | compliance obtain | you may not use this (?:file|work|software) except in compliance with the license you may obtain a copy of the license at
bsd | redistribution binary | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | neither endorse | neither the names? of (?:the )?(?:\S+ ){1,12}may be used to endorse or promote products
bsd-4-clause | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
gpl-3 | gnu redistribute | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
gpl-2 | gnu redistribute | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
gpl | gnu redistribute | redistribute it and or modify it under the terms of the gnu general public license
lgpl | lesser redistribute | redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl-2 | library redistribute | redistribute it and or modify it under the terms of the gnu library general public license
agpl-3 | affero redistribute | redistribute it and or modify it under the terms of the gnu affero general public license
gfdl | gnu copy | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2 | source mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | subject mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl | accompanying eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl-1 | subject distribution | the contents of this file are subject to the terms of the common development and distribution license
zlib | origin misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered plainly | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | do what the fuck you want to public license
wtfpl | fuck | you just do what the fuck you want to
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
postgresql | fee written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
python-cnri | cnri | cnri is making this software available to licensee on an as is basis
psf-2 | psf | psf is making python available to licensee on an as is basis
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 | php freely | this product includes php software freely available from
artistic | redistribute perl | you can redistribute it and or modify it under the same terms as perl itself
ruby | ruby redistribute | you can redistribute it and or modify it under the same terms as ruby
vim | vim unmodified | there are no restrictions on distributing unmodified copies of vim
ofl-1.1 | font sil | this font software is licensed under the sil open font license
ncsa | developed illinois | developed by (?:\S+ ){1,16}university of illinois
x11 | x consortium | the name of the x consortium shall not be used in advertising
eupl | eupl licensed | licensed under the eupl
cecill | cecill governed | this software is governed by the cecill(?: [bc])? license
lppl-1.3c | latex distributed | this work may be distributed and or modified under the conditions of the latex project public license
odbl-1 | database available | is made available under the open database license
cc0-1 | deed dedicated | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1 | waived neighboring | has waived all copyright and related or neighboring rights
cc-by | share adapt | you are free to share copy and redistribute the material in any medium or format adapt remix transform and build upon the material
cc | creative commons | this work is licensed under (?:a|the) creative commons
sspl-1 | server side | subject to the terms of the server side public license
elastic-2 | hosted managed | you may not provide the software to third parties as a hosted or managed service
busl-1.1 | licensor production | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
commons-clause | sell grant | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
proprietary | proprietary confidential | (?:is|are|contains?) (?:the )?(?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorized prohibited | unauthorized (?:copying|reproduction|use|distribution) (?:\S+ ){0,16}strictly prohibited
public-domain | public domain | (?:placed|released|dedicated) (?:in|into|to) the public domain
"""

#: Weak hints: label | gate words | pattern
HINTS = r"""
all-rights-reserved | rights reserved | all rights reserved
all-rights-reserved | rechte vorbehalten | alle rechte vorbehalten
all-rights-reserved | droits réservés | tous droits réservés
all-rights-reserved | derechos reservados | todos los derechos reservados
proprietary | proprietary license | proprietary (?:software )?licen[sc]e
public-domain | public domain | (?:is|are) in the public domain
non-commercial | non commercial only | for non commercial (?:use|purposes) only
non-commercial | noncommercial only | for noncommercial (?:use|purposes) only
"""

GRANT = (
    r"(?:(?:(?:dual |re)?licen[sc]ed|(?:re)?leased|(?:re)?distributed|published|available|provided|covered|governed|shared) )?"
    r"(?:(?:under|by|with) (?:an? |the )?(?:(?:terms|conditions|provisions) (?:and conditions )?of (?:an? |the )?)?"
    r"|unter (?:der |den |einer )?|sous (?:la )?(?:licence )?|bajo (?:la )?(?:licencia )?)"
)


class Rule(NamedTuple):
    name: str
    label: str
    tier: str
    gates: frozenset[bytes]
    pattern: re.Pattern


def _fields(table: str) -> Iterator[list[str]]:
    for line in table.strip().splitlines():
        yield [cell.strip() for cell in line.split("|", 2)]


def _version(found: re.Match) -> str:
    number = found[1].replace(".", " ")
    return rf"(?:version |ver |v |v)?{number}(?: 0)?"


def _rule(number: int, label: str, tier: str, gates: str, pattern: str) -> Rule:
    fixed = pattern
    while (shorter := re.sub(r"\(\?:[^()]*\)\??", "", fixed)) != fixed:  # without what is optional or one of several
        fixed = shorter
    words = frozenset(w.encode() for w in gates.split()) | ({b"license"} if re.search(r"\blicen\[sc\]e\b|\blicense\b", fixed) else set())
    pattern = re.sub(r"<([0-9.]+)>", _version, pattern)
    return Rule(f"{tier}-{label}-{number}", label, tier, words, re.compile(rf"(?<= )(?:{pattern})(?= )".encode()))


def build_rules() -> list[Rule]:
    """All rules in order of priority: tier by tier, in the order of the tables."""
    names = []
    for label, gates, rest in _fields(LICENSES):
        name, urls = rest.rsplit("|", 1)
        names.append((label, gates, name.strip(), [u.strip() for u in urls.split(";") if u.strip()]))
    rows: list[tuple[str, str, str, str]] = []
    for label in dict.fromkeys(n[0] for n in names):
        words = re.sub(r"[^a-z0-9]+", " ", label)
        tail = "" if re.search(r"[0-9]$", label) is None else "(?: 0)?"
        rows.append((label, "tag", "spdx identifier", rf"spdx license identifier {words}{tail}(?: only| or later)?"))
    rows += [(label, "text", gates, pattern) for label, gates, pattern in _fields(TEXTS)]
    for label, _, _, urls in names:
        rows += [(label, "url", " ".join(w for w in u.split() if w.isalnum()), rf"(?:https? )?(?:www )?{u}(?: \d+ \d+)?") for u in urls]
    rows += [(label, "grant", gates, GRANT + f"(?:{name})") for label, gates, name, _ in names]
    rows += [(label, "title", gates, name) for label, gates, name, _ in names]
    rows += [(label, "hint", gates, pattern) for label, gates, pattern in _fields(HINTS)]
    return [_rule(n, *row) for n, row in enumerate(rows)]


#: bytes that end a word become spaces, capitals become small
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Scanner:
    """Rules indexed by one gate word each; finds and resolves the detections of one text."""

    def __init__(self, rules: list[Rule], base: dict[str, str]):
        self.rules = rules
        self.base = [(f" {p} ".encode(), len(p.split()), label) for p, label in base.items()]
        self.tiers = list(TIERS)
        self.by_gate: dict[bytes, list[int]] = {}
        for n, rule in enumerate(rules):
            self.by_gate.setdefault(min(rule.gates, key=lambda w: (w == b"license", w)), []).append(n)
        self.gates = frozenset(w for r in rules for w in r.gates) | {b"licence"} | {w for p in base for w in p.encode().split()}
        self.needs = [frozenset(p.encode().split()) for p in base]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str, str, float]]]:
        """Number of words and the detections (start, end, label, rule, score), by word, end exclusive."""
        text = text.translate(_WORD)
        words, present = 0, set()
        for part in self._slices(text):
            found = part.split()
            words += len(found)
            present |= self.gates.intersection(found)
        if b"licence" in present:
            present.add(b"license")  # as a gate, one spelling stands for both
        tried = [n for w in present for n in self.by_gate.get(w, ()) if self.rules[n].gates <= present]
        if not tried and not any(need <= present for need in self.needs):
            return words, []
        parts = (b" ".join(part.split()) for part in self._slices(text))
        line = b" " + b" ".join(p for p in parts if p) + b" "
        spots = []  # start, end in bytes, order, label, rule, score
        for n in sorted(tried):
            rule = self.rules[n]
            for m in rule.pattern.finditer(line):
                spots.append((m.start(), m.end(), self.tiers.index(rule.tier), rule.label, rule.name, TIERS[rule.tier]))
        kept = self.resolve(spots)
        for phrase, _, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                kept.append((at + 1, at + len(phrase) - 1, -1, label, "base", BASE_SCORE))
                at = line.find(phrase, at + 1)
        return words, self._by_word(line, kept)

    @staticmethod
    def _slices(text: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):  # a word is never cut
                end = text.find(b" ", end)
                end = len(text) if end < 0 else end
            yield text[at:end]
            at = end

    @staticmethod
    def resolve(spots: list[tuple]) -> list[tuple]:
        """By tier, longer first: what lies inside a kept detection goes.

        ``starts`` and ``ends`` hold the kept detections that lie in no other; both ascend.
        """
        kept, starts, ends = [], [], []
        for spot in sorted(spots, key=lambda s: (s[2], s[0] - s[1], s[0], s[4])):
            a, b = spot[:2]
            i = bisect_right(starts, a) - 1
            if i >= 0 and ends[i] >= b:
                continue
            kept.append(spot)
            lo = bisect_left(starts, a)
            hi = bisect_right(ends, b)  # these begin at or after a and end by b
            starts[lo:hi] = [a]
            ends[lo:hi] = [b]
        return kept

    @staticmethod
    def _by_word(line: bytes, spots: list[tuple]) -> list[tuple]:
        """Byte spans as word spans; spaces are counted once along the line."""
        out, at, seen = [], 0, 0
        for a, b, _, label, rule, score in sorted(spots, key=lambda s: (s[0], s[1], s[3], s[4])):
            seen += line.count(b" ", at, a)
            at = a
            out.append((seen - 1, seen + line.count(b" ", a, b), label, rule, score))
        return out


FOUND = "array<struct<start: long, end: long, label: string, rule: string, score: double>>"
_ARROW_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("score", pa.float64())]))
_scanner: list[Scanner] = []


def _own_scanner() -> Scanner:
    """One scanner a Python worker: its patterns are compiled once, not shipped."""
    if not _scanner:
        _scanner.append(Scanner(build_rules(), BASE))
    return _scanner[0]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, found): every row's detections as word spans, ascending."""
    session(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _own_scanner()
        names = ("start", "end", "label", "rule", "score")
        for batch in batches:
            counts, found = [], []
            for value in batch.column(1):
                n, spots = scanner.scan(value.as_py() or b"")
                counts.append(n)
                found.append([dict(zip(names, s)) for s in spots])
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, _ARROW_FOUND)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "found"])

    return docs.select("doc_id", F.col("text").cast("string").cast("binary")).mapInArrow(run, f"doc_id {kind}, n_words long, found {FOUND}")


def _labels(spots: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spots, lambda s: s["label"]))), ",")


def summarise(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found."""
    base = F.filter("found", lambda s: s["rule"] == "base")
    starts = F.transform(base, lambda s: s["start"])
    best = F.array_max(F.transform("found", lambda s: s["score"]))
    return scan(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), _labels(base).alias("base_labels"), _labels(F.col("found")).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"), "found",
    )
