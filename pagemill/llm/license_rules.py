"""The signature rules of the license scan, written one by one over lower-case words between single spaces.

A line is: label, priority, keyword, regular expression. The keyword is a part of every text the expression fits, so a
text without it never meets the expression. Priorities: 50 identifiers of the SPDX list, 40 a grant ("licensed under"),
35 a full title with its version, 30 a title, 20 a short name beside the word license, 10 a name that stands alone.
No expression fits more than LONGEST words.
"""

from __future__ import annotations

#: How sure a rule of a priority is.
SCORES = {100: 1.0, 50: 1.0, 40: 0.95, 35: 0.9, 30: 0.8, 20: 0.7, 10: 0.6}
LONGEST = 32

RULES = r"""
mit | 50 | spdx | spdx licen[sc]e identifier mit
mit-0 | 50 | spdx | spdx licen[sc]e identifier mit 0
mit | 40 | under the mit | (?:licen[sc]ed|released|distributed|available|provided|published|covered|shared) under the mit licen[sc]e
mit | 40 | under mit | (?:licen[sc]ed|released|distributed|available|provided) under mit(?: licen[sc]e)?
mit | 40 | the mit licen | under the terms (?:of|and conditions of) the mit licen[sc]e
mit | 35 | mit x11 | mit x11 licen[sc]e
mit | 35 | under the mit | under the mit licen[sc]es?
mit | 30 | mit licen | mit licen[sc]e
mit | 30 | expat | expat licen[sc]e
mit | 30 | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy
mit | 20 | licen | licen[sc]e (?:is|type) (?:the )?mit
apache-2 | 50 | spdx | spdx licen[sc]e identifier apache 2 0
apache-1.1 | 50 | spdx | spdx licen[sc]e identifier apache 1 1
apache-1 | 50 | spdx | spdx licen[sc]e identifier apache 1 0
apache-2 | 40 | under the apache | (?:licen[sc]ed|released|distributed|available|provided|published|covered) under the apache licen[sc]e(?: version| v)? ?2(?: 0)?
apache-2 | 40 | under apache | (?:licen[sc]ed|released|distributed|available) under apache(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?
apache-2 | 35 | apache licen | apache licen[sc]e version 2(?: 0)?
apache-2 | 35 | apache licen | apache licen[sc]e v ?2(?: 0)?
apache-2 | 35 | apache licen | apache licen[sc]e 2(?: 0)?
apache-2 | 35 | apache software | apache software licen[sc]e(?: version| v)? ?2(?: 0)?
apache-2 | 30 | apache 2 | apache 2(?: 0)? licen[sc]e
apache-2 | 30 | apache org | www apache org licenses license 2 0
apache-2 | 20 | asl 2 | asl 2(?: 0)?
apache-1.1 | 35 | apache | apache(?: software)? licen[sc]e(?: version| v)? ?1 1
apache-1 | 35 | apache | apache(?: software)? licen[sc]e(?: version| v)? ?1 0
apache | 40 | under the apache | (?:licen[sc]ed|released|distributed|available|provided) under the apache(?: software)? licen[sc]e
apache | 30 | apache software | apache software licen[sc]e
apache | 30 | apache licen | apache licen[sc]e
apache | 20 | licen | licen[sc]e (?:is|type) (?:the )?apache
gpl-1 | 50 | spdx | spdx licen[sc]e identifier gpl 1 0(?: only| or later)?
gpl-2 | 50 | spdx | spdx licen[sc]e identifier gpl 2 0(?: only| or later)?
gpl-3 | 50 | spdx | spdx licen[sc]e identifier gpl 3 0(?: only| or later)?
gpl-2 | 40 | general public | under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e
gpl-3 | 40 | general public | under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e
gpl-2 | 40 | gpl | under the (?:gnu )?gpl(?: version| v)? ?2(?: 0)?(?: licen[sc]e)?
gpl-3 | 40 | gpl | under the (?:gnu )?gpl(?: version| v)? ?3(?: 0)?(?: licen[sc]e)?
gpl-2 | 35 | general public | (?:gnu )?general public licen[sc]e(?: version| v)? ?2(?: 0)?
gpl-3 | 35 | general public | (?:gnu )?general public licen[sc]e(?: version| v)? ?3(?: 0)?
gpl-2 | 35 | gpl version 2 | (?:gnu )?gpl version 2(?: 0)?(?: licen[sc]e)?
gpl-3 | 35 | gpl version 3 | (?:gnu )?gpl version 3(?: 0)?(?: licen[sc]e)?
gpl-2 | 30 | gpl 2 | (?:gnu )?gpl 2(?: 0)? licen[sc]e
gpl-3 | 30 | gpl 3 | (?:gnu )?gpl 3(?: 0)? licen[sc]e
gpl-2 | 30 | gplv2 | (?:gnu )?gplv2(?: licen[sc]e)?
gpl-3 | 30 | gplv3 | (?:gnu )?gplv3(?: licen[sc]e)?
gpl | 40 | gpl | under the (?:terms of the )?(?:gnu )?gpl(?: licen[sc]e)?
gpl | 40 | general public | under the (?:terms of the )?gnu general public licen[sc]e
gpl | 30 | general public | gnu general public licen[sc]e
gpl | 30 | gpl licen | (?:gnu )?gpl licen[sc]e
gpl | 20 | licen | licen[sc]e (?:is|type) (?:the )?(?:gnu )?gpl
lgpl-2 | 50 | spdx | spdx licen[sc]e identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | 50 | spdx | spdx licen[sc]e identifier lgpl 2 1(?: only| or later)?
lgpl-3 | 50 | spdx | spdx licen[sc]e identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 | 40 | lgpl | under the (?:terms of the )?(?:gnu )?lgpl(?: version| v)? ?2(?: 1)?
lgpl-3 | 40 | lgpl | under the (?:terms of the )?(?:gnu )?lgpl(?: version| v)? ?3(?: 0)?
lgpl-2.1 | 35 | lesser general | (?:gnu )?lesser general public licen[sc]e(?: version| v)? ?2(?: 1)?
lgpl-3 | 35 | lesser general | (?:gnu )?lesser general public licen[sc]e(?: version| v)? ?3(?: 0)?
lgpl-2 | 35 | library general | (?:gnu )?library general public licen[sc]e(?: version| v)? ?2(?: 0)?
lgpl-2.1 | 30 | lgplv2 | lgplv2(?: 1)?
lgpl-3 | 30 | lgplv3 | lgplv3
lgpl | 30 | lesser general | (?:gnu )?lesser general public licen[sc]e
lgpl | 30 | library general | gnu library general public licen[sc]e
lgpl | 30 | lgpl licen | (?:gnu )?lgpl licen[sc]e
agpl-3 | 50 | spdx | spdx licen[sc]e identifier agpl 3 0(?: only| or later)?
agpl-3 | 40 | agpl | under the (?:terms of the )?(?:gnu )?agpl(?: version| v)? ?3?(?: 0)?
agpl-3 | 35 | affero | (?:gnu )?affero general public licen[sc]e(?: version| v)? ?3(?: 0)?
agpl-3 | 30 | agplv3 | agplv3
agpl-3 | 30 | agpl licen | agpl licen[sc]e
agpl-3 | 30 | affero | (?:gnu )?affero general public licen[sc]e
gfdl | 50 | spdx | spdx licen[sc]e identifier gfdl 1 [123](?: only| or later)?
gfdl | 35 | free documentation | gnu free documentation licen[sc]e(?: version| v)? ?1 [123]
gfdl | 30 | free documentation | gnu free documentation licen[sc]e
bsd-1 | 50 | spdx | spdx licen[sc]e identifier bsd 1 clause
bsd-2 | 50 | spdx | spdx licen[sc]e identifier bsd 2 clause
bsd-3 | 50 | spdx | spdx licen[sc]e identifier bsd 3 clause
bsd-4 | 50 | spdx | spdx licen[sc]e identifier bsd 4 clause
0bsd | 50 | spdx | spdx licen[sc]e identifier 0bsd
bsd-2 | 40 | bsd | under the (?:terms of the )?(?:2|two) clause bsd licen[sc]e
bsd-3 | 40 | bsd | under the (?:terms of the )?(?:3|three) clause bsd licen[sc]e
bsd-2 | 35 | clause bsd | (?:2|two) clause bsd(?: licen[sc]e)?
bsd-3 | 35 | clause bsd | (?:3|three) clause bsd(?: licen[sc]e)?
bsd-4 | 35 | clause bsd | (?:4|four) clause bsd(?: licen[sc]e)?
bsd-2 | 35 | bsd 2 clause | bsd 2 clause(?: licen[sc]e)?
bsd-3 | 35 | bsd 3 clause | bsd 3 clause(?: licen[sc]e)?
bsd-4 | 35 | bsd 4 clause | bsd 4 clause(?: licen[sc]e)?
bsd-2 | 30 | simplified bsd | simplified bsd(?: licen[sc]e)?
bsd-2 | 30 | freebsd licen | freebsd licen[sc]e
bsd-3 | 30 | new bsd | new bsd(?: licen[sc]e)?
bsd-3 | 30 | revised bsd | revised bsd(?: licen[sc]e)?
bsd-3 | 30 | modified bsd | modified bsd(?: licen[sc]e)?
bsd-4 | 30 | original bsd | original bsd(?: licen[sc]e)?
bsd | 40 | bsd | under the (?:terms of the )?bsd licen[sc]e
bsd | 30 | bsd licen | bsd licen[sc]e
bsd | 30 | bsd style | bsd style licen[sc]e
bsd | 20 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd | 20 | licen | licen[sc]e (?:is|type) (?:the )?bsd
mpl-1.1 | 50 | spdx | spdx licen[sc]e identifier mpl 1 1
mpl-2 | 50 | spdx | spdx licen[sc]e identifier mpl 2 0
mpl-2 | 40 | mozilla | (?:subject to|under) the terms of the mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?
mpl-2 | 35 | mozilla | mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?
mpl-1.1 | 35 | mozilla | mozilla public licen[sc]e(?: version| v)? ?1 1
mpl-2 | 30 | mpl 2 | mpl 2(?: 0)?(?: licen[sc]e)?
mpl-1.1 | 30 | mpl 1 1 | mpl 1 1(?: licen[sc]e)?
mpl | 30 | mozilla | mozilla public licen[sc]e
mpl | 30 | mpl licen | mpl licen[sc]e
epl-1 | 50 | spdx | spdx licen[sc]e identifier epl 1 0
epl-2 | 50 | spdx | spdx licen[sc]e identifier epl 2 0
epl-2 | 40 | eclipse | under the terms of the eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?
epl-1 | 40 | eclipse | under the terms of the eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?
epl-2 | 35 | eclipse | eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?
epl-1 | 35 | eclipse | eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?
epl | 30 | eclipse | eclipse public licen[sc]e
edl-1 | 30 | eclipse | eclipse distribution licen[sc]e(?: version| v)? ?1?(?: 0)?
cddl-1 | 50 | spdx | spdx licen[sc]e identifier cddl 1 [01]
cddl-1 | 35 | common development | common development and distribution licen[sc]e(?: version| v)? ?1 [01]
cddl | 30 | common development | common development and distribution licen[sc]e
cddl | 30 | cddl | cddl(?: licen[sc]e)?
cpl-1 | 50 | spdx | spdx licen[sc]e identifier cpl 1 0
cpl-1 | 30 | common public | common public licen[sc]e(?: version| v)? ?1?(?: 0)?
ipl-1 | 30 | ibm public | ibm public licen[sc]e(?: version| v)? ?1?(?: 0)?
isc | 50 | spdx | spdx licen[sc]e identifier isc
isc | 40 | isc licen | under the (?:terms of the )?isc licen[sc]e
isc | 30 | isc licen | isc licen[sc]e
zlib | 50 | spdx | spdx licen[sc]e identifier zlib
zlib | 40 | zlib | under the (?:terms of the )?zlib(?: libpng)? licen[sc]e
zlib | 30 | zlib | zlib(?: libpng)? licen[sc]e
libpng | 30 | libpng licen | libpng licen[sc]e
boost-1 | 50 | spdx | spdx licen[sc]e identifier bsl 1 0
boost-1 | 40 | boost software | (?:distributed|licen[sc]ed) under the boost software licen[sc]e(?: version| v)? ?1?(?: 0)?
boost-1 | 35 | boost software | boost software licen[sc]e(?: version| v)? ?1(?: 0)?
boost-1 | 30 | boost software | boost software licen[sc]e
unlicense | 50 | spdx | spdx licen[sc]e identifier unlicense
unlicense | 40 | unlicense | under the unlicense
unlicense | 30 | unlicense | the unlicense
unlicense | 20 | free and unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 50 | spdx | spdx licen[sc]e identifier wtfpl
wtfpl | 30 | wtfpl | wtfpl(?: licen[sc]e)?
wtfpl | 30 | do what the fuck | do what the fuck you want to public licen[sc]e
artistic-1 | 50 | spdx | spdx licen[sc]e identifier artistic 1 0
artistic-2 | 50 | spdx | spdx licen[sc]e identifier artistic 2 0
artistic-2 | 35 | artistic licen | (?:perl )?artistic licen[sc]e(?: version| v)? ?2(?: 0)?
artistic-1 | 35 | artistic licen | (?:perl )?artistic licen[sc]e(?: version| v)? ?1(?: 0)?
artistic | 30 | artistic licen | (?:perl )?artistic licen[sc]e
python-2 | 50 | spdx | spdx licen[sc]e identifier (?:python|psf) 2 0
python-2 | 35 | python software | python software foundation licen[sc]e(?: version| v)? ?2(?: 0)?
python-2 | 30 | python software | python software foundation licen[sc]e
python-2 | 30 | psf licen | psf licen[sc]e
postgresql | 50 | spdx | spdx licen[sc]e identifier postgresql
postgresql | 30 | postgresql licen | postgresql licen[sc]e
openssl | 50 | spdx | spdx licen[sc]e identifier openssl
openssl | 30 | openssl licen | openssl licen[sc]e
ofl-1.1 | 50 | spdx | spdx licen[sc]e identifier ofl 1 1
ofl-1.1 | 40 | open font | under the sil open font licen[sc]e(?: version| v)? ?1?(?: 1)?
ofl-1.1 | 35 | open font | (?:sil )?open font licen[sc]e(?: version| v)? ?1 1
ofl-1.1 | 30 | open font | (?:sil )?open font licen[sc]e
odbl-1 | 50 | spdx | spdx licen[sc]e identifier odbl 1 0
odbl-1 | 35 | open database | open (?:data commons open )?database licen[sc]e(?: version| v)? ?1?(?: 0)?
odbl-1 | 30 | odbl | odbl(?: licen[sc]e)?
odc-by-1 | 50 | spdx | spdx licen[sc]e identifier odc by 1 0
odc-by-1 | 30 | open data commons | open data commons attribution licen[sc]e
pddl-1 | 50 | spdx | spdx licen[sc]e identifier pddl 1 0
pddl-1 | 30 | public domain dedication | public domain dedication and licen[sc]e
eupl-1.1 | 50 | spdx | spdx licen[sc]e identifier eupl 1 1
eupl-1.2 | 50 | spdx | spdx licen[sc]e identifier eupl 1 2
eupl | 30 | european union public | european union public licen[sc]e(?: version| v)?(?: 1 [012])?
eupl | 30 | eupl | eupl(?: 1 [012])?(?: licen[sc]e)?
ms-pl | 50 | spdx | spdx licen[sc]e identifier ms pl
ms-rl | 50 | spdx | spdx licen[sc]e identifier ms rl
ms-pl | 30 | microsoft public | microsoft public licen[sc]e
ms-rl | 30 | microsoft reciprocal | microsoft reciprocal licen[sc]e
cecill-2.1 | 50 | spdx | spdx licen[sc]e identifier cecill 2 [01]
cecill | 30 | cecill | cecill(?: [bc])?(?: licen[sc]e)?
afl-3 | 50 | spdx | spdx licen[sc]e identifier afl 3 0
afl-3 | 30 | academic free | academic free licen[sc]e(?: version| v)?(?: [123] [01])?
osl-3 | 50 | spdx | spdx licen[sc]e identifier osl 3 0
osl-3 | 30 | open software licen | open software licen[sc]e(?: version| v)?(?: [123] [01])?
ecl-2 | 50 | spdx | spdx licen[sc]e identifier ecl 2 0
ecl-2 | 30 | educational community | educational community licen[sc]e(?: version| v)?(?: 2 0)?
upl-1 | 50 | spdx | spdx licen[sc]e identifier upl 1 0
upl-1 | 30 | universal permissive | universal permissive licen[sc]e(?: version| v)?(?: 1 0)?
blueoak-1 | 50 | spdx | spdx licen[sc]e identifier blueoak 1 0 0
blueoak-1 | 30 | blue oak | blue oak model licen[sc]e(?: version| v)?(?: 1 0 0)?
ncsa | 50 | spdx | spdx licen[sc]e identifier ncsa
ncsa | 30 | ncsa | (?:university of illinois )?ncsa open source licen[sc]e
vim | 30 | vim licen | vim licen[sc]e
ruby | 30 | ruby licen | ruby licen[sc]e
php-3 | 30 | php licen | php licen[sc]e(?: version| v)?(?: 3 0[01]?)?
qpl-1 | 30 | q public | q public licen[sc]e(?: version| v)?(?: 1 0)?
sleepycat | 30 | sleepycat licen | sleepycat licen[sc]e
beerware | 30 | licen | beer ?ware licen[sc]e
json | 20 | good not evil | the software shall be used for good not evil
sspl-1 | 50 | spdx | spdx licen[sc]e identifier sspl 1 0
sspl-1 | 30 | server side public | server side public licen[sc]e(?: version| v)?(?: ?1)?
elastic-2 | 50 | spdx | spdx licen[sc]e identifier elastic 2 0
elastic-2 | 30 | elastic licen | elastic licen[sc]e(?: version| v)?(?: ?2)?(?: 0)?
busl-1.1 | 50 | spdx | spdx licen[sc]e identifier busl 1 1
busl-1.1 | 30 | business source | business source licen[sc]e(?: version| v)?(?: 1 1)?
commons-clause | 30 | commons clause | commons clause(?: licen[sc]e)?(?: condition)?
cc0 | 50 | spdx | spdx licen[sc]e identifier cc0 1 0
cc-by | 50 | spdx | spdx licen[sc]e identifier cc by [1234] 0
cc-by-sa | 50 | spdx | spdx licen[sc]e identifier cc by sa [1234] 0
cc-by-nd | 50 | spdx | spdx licen[sc]e identifier cc by nd [1234] 0
cc-by-nc | 50 | spdx | spdx licen[sc]e identifier cc by nc [1234] 0
cc-by-nc-sa | 50 | spdx | spdx licen[sc]e identifier cc by nc sa [1234] 0
cc-by-nc-nd | 50 | spdx | spdx licen[sc]e identifier cc by nc nd [1234] 0
cc0 | 35 | creative commons zero | creative commons zero(?: 1 0)?(?: universal)?(?: licen[sc]e)?
cc-by | 35 | creative commons attribution | creative commons attribution(?: [1234] 0)?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-sa | 35 | creative commons attribution | creative commons attribution share ?alike(?: [1234] 0)?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nd | 35 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s(?: [1234] 0)?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nc | 35 | creative commons attribution | creative commons attribution non ?commercial(?: [1234] 0)?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nc-sa | 35 | creative commons attribution | creative commons attribution non ?commercial share ?alike(?: [1234] 0)?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nc-nd | 35 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] 0)?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by | 40 | creativecommons org | creativecommons org licenses by [1234] 0
cc-by-sa | 40 | creativecommons org | creativecommons org licenses by sa [1234] 0
cc-by-nd | 40 | creativecommons org | creativecommons org licenses by nd [1234] 0
cc-by-nc | 40 | creativecommons org | creativecommons org licenses by nc [1234] 0
cc-by-nc-sa | 40 | creativecommons org | creativecommons org licenses by nc sa [1234] 0
cc-by-nc-nd | 40 | creativecommons org | creativecommons org licenses by nc nd [1234] 0
cc0 | 40 | creativecommons org | creativecommons org publicdomain zero 1 0
cc0 | 10 | cc0 | cc0(?: 1 0)?(?: universal)?
cc-by | 10 | cc by | cc by(?: [1234] 0)?
cc-by-sa | 10 | cc by sa | cc by sa(?: [1234] 0)?
cc-by-nd | 10 | cc by nd | cc by nd(?: [1234] 0)?
cc-by-nc | 10 | cc by nc | cc by nc(?: [1234] 0)?
cc-by-nc-sa | 10 | cc by nc sa | cc by nc sa(?: [1234] 0)?
cc-by-nc-nd | 10 | cc by nc nd | cc by nc nd(?: [1234] 0)?
public-domain | 30 | public domain | (?:released|dedicated|placed) (?:in|into|to) the public domain
public-domain | 10 | public domain | public domain
proprietary | 50 | spdx | spdx licen[sc]e identifier licenseref proprietary
proprietary | 30 | proprietary | proprietary and confidential
proprietary | 30 | proprietary licen | proprietary licen[sc]e
proprietary | 10 | all rights reserved | all rights reserved
"""
