"""The signatures of the licence scan, in order.

A line is ``label | level | gate | regex``. The regex meets whole words of the text, lower-cased and
joined by single spaces (so "Version 2.0," is ``version 2 0``); the gate is a piece of text that every
match holds, and rules whose gate a text lacks aren't tried. Levels: 4 a notice, an identifier tag or a
text of its own, 3 a name with its version, 2 a name, 1 a general clue.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: What a level is worth.
WORTH = {4: 1.0, 3: 0.9, 2: 0.7, 1: 0.4}

RULES = r"""
mit | 4 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 4 | identifier mit | spdx licen[cs]e identifier mit
mit | 3 | mit licen | (?:released|licensed|distributed|available|published|provided) under the (?:terms of the )?mit licen[cs]e
mit | 3 | mit licen | the mit licen[cs]e(?: mit)?
mit | 2 | mit licen | mit licen[cs]ed?
mit | 2 | licen | licen[cs]ed? (?:type |is |name )?mit
mit | 3 | opensource org licenses mit | (?:www )?opensource org licenses mit(?: license)?(?: php| html)?
mit | 2 | expat | expat licen[cs]e
mit-0 | 4 | identifier mit 0 | spdx licen[cs]e identifier mit 0
mit-0 | 3 | mit no attribution | mit no attribution(?: licen[cs]e)?
x11 | 4 | identifier x11 | spdx licen[cs]e identifier x11
x11 | 3 | x11 | (?:mit )?x11 licen[cs]e
isc | 4 | permission to use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 4 | identifier isc | spdx licen[cs]e identifier isc
isc | 3 | isc licen | (?:under the )?isc licen[cs]e
0bsd | 4 | identifier 0bsd | spdx licen[cs]e identifier 0bsd
0bsd | 3 | zero clause bsd | (?:bsd )?zero clause bsd(?: licen[cs]e)?
bsd-2-clause | 4 | identifier bsd 2 clause | spdx licen[cs]e identifier bsd 2 clause
bsd-2-clause | 3 | bsd | (?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)?
bsd-2-clause | 3 | bsd 2 clause | bsd 2 clause(?: licen[cs]e| simplified)?
bsd-2-clause | 3 | opensource org licenses bsd license | (?:www )?opensource org licenses bsd license(?: php)?
bsd-3-clause | 4 | identifier bsd 3 clause | spdx licen[cs]e identifier bsd 3 clause
bsd-3-clause | 3 | bsd | (?:new|revised|modified|3 clause|three clause) bsd(?: licen[cs]e)?
bsd-3-clause | 3 | bsd 3 clause | bsd 3 clause(?: licen[cs]e| new| revised)?
bsd-3-clause | 4 | contributors may be used | neither the name of .{1,120}? nor the names of (?:its|their) contributors may be used to endorse or promote products
bsd-4-clause | 4 | identifier bsd 4 clause | spdx licen[cs]e identifier bsd 4 clause
bsd-4-clause | 4 | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause | 3 | bsd | (?:original|4 clause|four clause) bsd(?: licen[cs]e)?
bsd | 4 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 2 | bsd | bsd (?:style )?licen[cs]ed?
bsd | 2 | bsd | licen[cs]ed? (?:under )?(?:the )?bsd
apache-1.1 | 4 | identifier apache 1 1 | spdx licen[cs]e identifier apache 1 1
apache-1.1 | 3 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?1 1
apache-1.0 | 3 | apache | apache (?:software )?licen[cs]e (?:version |v ?)?1 0
apache-2.0 | 4 | licensed under the apache | licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e
apache-2.0 | 4 | identifier apache 2 0 | spdx licen[cs]e identifier apache 2 0
apache-2.0 | 3 | apache | (?:released |distributed |available )?(?:licensed )?(?:under )?(?:the )?(?:terms of the )?apache (?:software |public )?licen[cs]e (?:version |v ?)?2(?: 0)?
apache-2.0 | 3 | apache | apache (?:version |v ?)?2 0(?: licen[cs]ed?)?
apache-2.0 | 3 | apache org licenses license 2 0 | (?:www )?apache org licenses license 2 0(?: html| txt)?
apache-2.0 | 3 | opensource org licenses apache 2 0 | opensource org licenses apache 2 0
apache | 2 | apache | apache (?:software |public )?licen[cs]ed?
gpl-1.0 | 4 | identifier gpl 1 0 | spdx licen[cs]e identifier gpl 1 0(?: only| or later)?
gpl-1.0 | 3 | general public licen | gnu general public licen[cs]e (?:gpl )?(?:version |v ?)1(?: 0)?
gpl-2.0-or-later | 4 | general public licen | gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
gpl-2.0-or-later | 4 | identifier gpl 2 0 or later | spdx licen[cs]e identifier gpl 2 0 or later
gpl-2.0-or-later | 3 | general public licen | gnu general public licen[cs]e (?:gpl )?(?:version |v ?)2(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?
gpl-2.0-or-later | 3 | gpl | gpl ?v?(?:ersion )?2(?: 0)? or (?:any )?later
gpl-2.0 | 4 | identifier gpl 2 0 | spdx licen[cs]e identifier gpl 2 0(?: only)?
gpl-2.0 | 4 | general public licen | gnu general public licen[cs]e version 2 (?:only )?as published by the free software foundation
gpl-2.0 | 3 | general public licen | (?:gnu )?general public licen[cs]e (?:gpl )?(?:version |v ?)2(?: 0)?(?: only)?
gpl-2.0 | 3 | gpl | (?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?(?: only| licen[cs]e)?
gpl-2.0 | 3 | gnu org licenses | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3.0-or-later | 4 | general public licen | gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
gpl-3.0-or-later | 4 | identifier gpl 3 0 or later | spdx licen[cs]e identifier gpl 3 0 or later
gpl-3.0-or-later | 3 | general public licen | gnu general public licen[cs]e (?:gpl )?(?:version |v ?)3(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?
gpl-3.0-or-later | 3 | gpl | gpl ?v?(?:ersion )?3(?: 0)? or (?:any )?later
gpl-3.0 | 4 | identifier gpl 3 0 | spdx licen[cs]e identifier gpl 3 0(?: only)?
gpl-3.0 | 4 | general public licen | gnu general public licen[cs]e version 3 29 june 2007
gpl-3.0 | 3 | general public licen | (?:gnu )?general public licen[cs]e (?:gpl )?(?:version |v ?)3(?: 0)?(?: only)?
gpl-3.0 | 3 | gpl | (?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?(?: only| licen[cs]e)?
gpl-3.0 | 3 | gnu org licenses | (?:www )?gnu org licenses gpl 3 0(?: html| txt)?
gpl | 2 | general public licen | (?:gnu )?general public licen[cs]e
gpl | 2 | gpl | (?:gnu )?gpl licen[cs]ed?
gpl | 2 | gnu gpl | gnu gpl
gpl | 2 | gnu org | (?:www )?gnu org (?:licenses|copyleft) gpl(?: html| txt)?
lgpl-2.0 | 4 | identifier lgpl 2 0 | spdx licen[cs]e identifier lgpl 2 0(?: only| or later)?
lgpl-2.0 | 3 | library general public licen | gnu library general public licen[cs]e(?: version 2(?: 0)?)?
lgpl-2.1-or-later | 4 | identifier lgpl 2 1 or later | spdx licen[cs]e identifier lgpl 2 1 or later
lgpl-2.1-or-later | 4 | lesser general public licen | gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e or at your option any later version
lgpl-2.1 | 4 | identifier lgpl 2 1 | spdx licen[cs]e identifier lgpl 2 1(?: only)?
lgpl-2.1 | 3 | lesser general public licen | (?:gnu )?lesser general public licen[cs]e (?:lgpl )?(?:version |v ?)2 1
lgpl-2.1 | 3 | lgpl | (?:gnu )?lgpl ?(?:version |v ?)?2 1
lgpl-3.0-or-later | 4 | identifier lgpl 3 0 or later | spdx licen[cs]e identifier lgpl 3 0 or later
lgpl-3.0-or-later | 4 | lesser general public licen | gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
lgpl-3.0 | 4 | identifier lgpl 3 0 | spdx licen[cs]e identifier lgpl 3 0(?: only)?
lgpl-3.0 | 3 | lesser general public licen | (?:gnu )?lesser general public licen[cs]e (?:lgpl )?(?:version |v ?)3(?: 0)?
lgpl-3.0 | 3 | lgpl | (?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)?
lgpl | 2 | lesser general public licen | (?:gnu )?lesser general public licen[cs]e
lgpl | 2 | lgpl | (?:gnu )?lgpl(?: licen[cs]ed?)?
agpl-1.0 | 4 | identifier agpl 1 0 | spdx licen[cs]e identifier agpl 1 0(?: only| or later)?
agpl-3.0-or-later | 4 | identifier agpl 3 0 or later | spdx licen[cs]e identifier agpl 3 0 or later
agpl-3.0-or-later | 4 | affero general public licen | gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
agpl-3.0 | 4 | identifier agpl 3 0 | spdx licen[cs]e identifier agpl 3 0(?: only)?
agpl-3.0 | 3 | affero general public licen | (?:gnu )?affero general public licen[cs]e (?:agpl )?(?:version |v ?)3(?: 0)?
agpl-3.0 | 3 | agpl | (?:gnu )?agpl ?(?:version |v ?)?3(?: 0)?
agpl | 2 | affero general public licen | (?:gnu )?affero general public licen[cs]e
agpl | 2 | agpl | (?:gnu )?agpl(?: licen[cs]ed?)?
sspl-1.0 | 4 | identifier sspl 1 0 | spdx licen[cs]e identifier sspl 1 0
sspl-1.0 | 3 | server side public licen | server side public licen[cs]e(?: (?:version |v ?)1(?: 0)?)?
gfdl-1.1 | 4 | identifier gfdl 1 1 | spdx licen[cs]e identifier gfdl 1 1(?: only| or later)?
gfdl-1.2 | 4 | identifier gfdl 1 2 | spdx licen[cs]e identifier gfdl 1 2(?: only| or later)?
gfdl-1.3 | 4 | identifier gfdl 1 3 | spdx licen[cs]e identifier gfdl 1 3(?: only| or later)?
gfdl-1.1 | 3 | free documentation licen | gnu free documentation licen[cs]e (?:version |v ?)1 1
gfdl-1.2 | 3 | free documentation licen | gnu free documentation licen[cs]e (?:version |v ?)1 2
gfdl-1.3 | 3 | free documentation licen | gnu free documentation licen[cs]e (?:version |v ?)1 3
gfdl | 2 | free documentation licen | (?:gnu )?free documentation licen[cs]e
gfdl | 2 | gfdl | gfdl
mpl-1.0 | 4 | identifier mpl 1 0 | spdx licen[cs]e identifier mpl 1 0
mpl-1.0 | 3 | mozilla public licen | mozilla public licen[cs]e (?:mpl )?(?:version |v ?)?1 0
mpl-1.1 | 4 | identifier mpl 1 1 | spdx licen[cs]e identifier mpl 1 1
mpl-1.1 | 3 | mozilla public licen | mozilla public licen[cs]e (?:mpl )?(?:version |v ?)?1 1
mpl-2.0 | 4 | this source code form is subject | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2.0 | 4 | identifier mpl 2 0 | spdx licen[cs]e identifier mpl 2 0
mpl-2.0 | 3 | mozilla public licen | mozilla public licen[cs]e (?:mpl )?(?:version |v ?)?2(?: 0)?
mpl-2.0 | 3 | mozilla org | (?:www )?mozilla org (?:en us )?mpl 2 0
mpl | 2 | mozilla public licen | mozilla public licen[cs]e
epl-1.0 | 4 | identifier epl 1 0 | spdx licen[cs]e identifier epl 1 0
epl-1.0 | 3 | eclipse public licen | eclipse public licen[cs]e (?:epl )?(?:version |v ?)?1(?: 0)?
epl-2.0 | 4 | identifier epl 2 0 | spdx licen[cs]e identifier epl 2 0
epl-2.0 | 3 | eclipse public licen | eclipse public licen[cs]e (?:epl )?(?:version |v ?)?2(?: 0)?
epl-2.0 | 3 | eclipse org | (?:www )?eclipse org legal epl 2 0
epl-1.0 | 3 | eclipse org | (?:www )?eclipse org legal epl v10(?: html)?
epl | 2 | eclipse public licen | eclipse public licen[cs]e
edl-1.0 | 3 | eclipse distribution licen | eclipse distribution licen[cs]e(?: (?:version |v ?)?1 0)?
cddl-1.0 | 4 | identifier cddl 1 0 | spdx licen[cs]e identifier cddl 1 0
cddl-1.0 | 3 | common development and distribution licen | common development and distribution licen[cs]e (?:cddl )?(?:version |v ?)?1 0
cddl-1.1 | 4 | identifier cddl 1 1 | spdx licen[cs]e identifier cddl 1 1
cddl-1.1 | 3 | common development and distribution licen | common development and distribution licen[cs]e (?:cddl )?(?:version |v ?)?1 1
cddl | 2 | common development and distribution licen | common development and distribution licen[cs]e
cddl | 2 | cddl | cddl
cpl-1.0 | 4 | identifier cpl 1 0 | spdx licen[cs]e identifier cpl 1 0
cpl-1.0 | 3 | common public licen | common public licen[cs]e(?: (?:version |v ?)?1 0)?
ipl-1.0 | 3 | ibm public licen | ibm public licen[cs]e(?: (?:version |v ?)?1 0)?
eupl-1.1 | 4 | identifier eupl 1 1 | spdx licen[cs]e identifier eupl 1 1
eupl-1.1 | 3 | european union public licen | european union public licen[cs]e (?:eupl )?(?:version |v ?)?1 1
eupl-1.2 | 4 | identifier eupl 1 2 | spdx licen[cs]e identifier eupl 1 2
eupl-1.2 | 3 | european union public licen | european union public licen[cs]e (?:eupl )?(?:version |v ?)?1 2
eupl | 2 | european union public licen | european union public licen[cs]e
artistic-1.0 | 4 | identifier artistic 1 0 | spdx licen[cs]e identifier artistic 1 0
artistic-1.0 | 3 | artistic licen | (?:the )?artistic licen[cs]e (?:version |v ?)?1 0
artistic-2.0 | 4 | identifier artistic 2 0 | spdx licen[cs]e identifier artistic 2 0
artistic-2.0 | 3 | artistic licen | (?:the )?artistic licen[cs]e (?:version |v ?)?2(?: 0)?
artistic | 2 | artistic licen | (?:the )?artistic licen[cs]e
perl | 4 | as perl | (?:under )?the same terms as perl itself
afl-3.0 | 4 | identifier afl 3 0 | spdx licen[cs]e identifier afl 3 0
afl-3.0 | 3 | academic free licen | academic free licen[cs]e (?:version |v ?)?3 0
afl-2.1 | 3 | academic free licen | academic free licen[cs]e (?:version |v ?)?2 1
afl | 2 | academic free licen | academic free licen[cs]e
osl-3.0 | 4 | identifier osl 3 0 | spdx licen[cs]e identifier osl 3 0
osl-3.0 | 3 | open software licen | open software licen[cs]e (?:osl )?(?:version |v ?)?3 0
osl-2.1 | 3 | open software licen | open software licen[cs]e (?:osl )?(?:version |v ?)?2 1
osl | 2 | open software licen | open software licen[cs]e
bsl-1.0 | 4 | identifier bsl 1 0 | spdx licen[cs]e identifier bsl 1 0
bsl-1.0 | 3 | boost software licen | boost software licen[cs]e(?: (?:version |v ?)?1 0)?
bsl-1.0 | 3 | boost org license | (?:www )?boost org license 1 0(?: txt)?
busl-1.1 | 4 | identifier busl 1 1 | spdx licen[cs]e identifier busl 1 1
busl-1.1 | 3 | business source licen | business source licen[cs]e(?: (?:version |v ?)?1 1)?
elastic-2.0 | 4 | identifier elastic 2 0 | spdx licen[cs]e identifier elastic 2 0
elastic-2.0 | 3 | elastic licen | elastic licen[cs]e (?:version |v ?)?2(?: 0)?
elastic | 2 | elastic licen | elastic licen[cs]e
commons-clause | 3 | commons clause | commons clause licen[cs]e condition(?: v1 0)?
zlib | 4 | express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib | 4 | identifier zlib | spdx licen[cs]e identifier zlib
zlib | 3 | zlib | zlib(?: libpng)? licen[cs]e
libpng-2.0 | 4 | identifier libpng 2 0 | spdx licen[cs]e identifier libpng 2 0
libpng | 3 | libpng licen | libpng licen[cs]e
unlicense | 4 | this is free and unencumbered software | this is free and unencumbered software released into the public domain
unlicense | 4 | identifier unlicense | spdx licen[cs]e identifier unlicense
unlicense | 3 | unlicense | (?:the )?unlicense
unlicense | 3 | unlicense org | (?:www )?unlicense org
wtfpl | 4 | identifier wtfpl | spdx licen[cs]e identifier wtfpl
wtfpl | 3 | what the fuck | do what the fuck you want to public licen[cs]e
wtfpl | 3 | wtfpl | wtfpl(?: licen[cs]e| version 2)?
beerware | 3 | beer ware | (?:the )?beer ware licen[cs]e
python-2.0 | 4 | identifier python 2 0 | spdx licen[cs]e identifier python 2 0
psf-2.0 | 4 | identifier psf 2 0 | spdx licen[cs]e identifier psf 2 0
psf-2.0 | 3 | python software foundation licen | python software foundation licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
php-3.01 | 4 | identifier php 3 01 | spdx licen[cs]e identifier php 3 01
php-3.01 | 3 | php licen | php licen[cs]e (?:version |v ?)?3 01
php | 2 | php licen | php licen[cs]e
ruby | 3 | ruby licen | (?:the )?ruby licen[cs]e
openssl | 4 | identifier openssl | spdx licen[cs]e identifier openssl
openssl | 3 | openssl licen | openssl licen[cs]e
curl | 4 | identifier curl | spdx licen[cs]e identifier curl
postgresql | 4 | identifier postgresql | spdx licen[cs]e identifier postgresql
postgresql | 3 | postgresql licen | (?:the )?postgresql licen[cs]e
ncsa | 4 | identifier ncsa | spdx licen[cs]e identifier ncsa
ncsa | 3 | ncsa open source licen | (?:university of illinois )?ncsa open source licen[cs]e
vim | 4 | identifier vim | spdx licen[cs]e identifier vim
vim | 3 | vim licen | (?:the )?vim licen[cs]e
w3c | 4 | identifier w3c | spdx licen[cs]e identifier w3c
w3c | 3 | w3c software | w3c software (?:notice and|and document) (?:notice and )?licen[cs]e
upl-1.0 | 4 | identifier upl 1 0 | spdx licen[cs]e identifier upl 1 0
upl-1.0 | 3 | universal permissive licen | universal permissive licen[cs]e(?: (?:upl )?(?:version |v ?)?1 0)?
ms-pl | 4 | identifier ms pl | spdx licen[cs]e identifier ms pl
ms-pl | 3 | microsoft public licen | microsoft public licen[cs]e(?: ms pl)?
ms-rl | 3 | microsoft reciprocal licen | microsoft reciprocal licen[cs]e(?: ms rl)?
mulan-psl-2.0 | 3 | mulan | mulan permissive software licen[cs]e(?: mulanpsl)?(?: (?:version |v ?)?2)?
cecill-2.1 | 4 | identifier cecill 2 1 | spdx licen[cs]e identifier cecill 2 1
cecill | 3 | cecill | cecill(?: [bc])?(?: licen[cs]e)?(?: (?:version |v ?)?2 [01])?
ofl-1.1 | 4 | identifier ofl 1 1 | spdx licen[cs]e identifier ofl 1 1
ofl-1.1 | 3 | open font licen | (?:sil )?open font licen[cs]e(?: (?:version |v ?)?1 1)?
ofl-1.1 | 3 | scripts sil org ofl | scripts sil org ofl
bitstream-vera | 3 | bitstream vera | bitstream vera fonts? (?:copyright|licen[cs]e)
ijg | 3 | independent jpeg group | based in part on the work of the independent jpeg group
tcl | 3 | tcl licen | tcl (?:tk )?licen[cs]e
qpl-1.0 | 3 | q public licen | q public licen[cs]e(?: (?:version |v ?)?1 0)?
sleepycat | 3 | sleepycat licen | sleepycat licen[cs]e
blueoak-1.0.0 | 3 | blue oak model licen | blue oak model licen[cs]e(?: 1 0 0)?
hippocratic | 3 | hippocratic licen | hippocratic licen[cs]e(?: 2 1)?
parity | 3 | parity public licen | parity public licen[cs]e(?: 7 0 0)?
polyform | 3 | polyform | polyform (?:noncommercial|small business|perimeter|shield|strict|internal use|free trial) licen[cs]e(?: 1 0 0)?
rail | 3 | responsible ai licen | (?:creativeml |bigscience )?(?:open )?(?:rail m? ?)?responsible ai licen[cs]e
rail | 3 | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[cs]e)?
llama | 3 | community licen | llama (?:2 |3 |3 1 |3 2 )?community licen[cs]e(?: agreement)?
odc-by-1.0 | 4 | identifier odc by 1 0 | spdx licen[cs]e identifier odc by 1 0
odc-by-1.0 | 3 | open data commons attribution licen | open data commons attribution licen[cs]e
odbl-1.0 | 4 | identifier odbl 1 0 | spdx licen[cs]e identifier odbl 1 0
odbl-1.0 | 3 | open database licen | (?:open data commons )?open database licen[cs]e(?: odbl)?(?: v1 0)?
pddl-1.0 | 3 | public domain dedication and licen | (?:open data commons )?public domain dedication and licen[cs]e
cdla-permissive | 3 | community data licen | community data licen[cs]e agreement permissive(?: version [12] 0)?
cdla-sharing | 3 | community data licen | community data licen[cs]e agreement sharing(?: version 1 0)?
ogl-3.0 | 3 | open government licen | open government licen[cs]e (?:version |v ?)?3 0
ogl | 2 | open government licen | open government licen[cs]e
etalab-2.0 | 3 | licence ouverte | licence ouverte(?: open licence)?(?: (?:version )?2 0)?
cc0-1.0 | 4 | identifier cc0 1 0 | spdx licen[cs]e identifier cc0 1 0
cc0-1.0 | 4 | waived all copyright | has waived all copyright and related or neighbou?ring rights
cc0-1.0 | 3 | cc0 | (?:creative commons )?(?:zero )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | 3 | creative commons zero | creative commons zero(?: 1 0)?(?: universal)?
cc0-1.0 | 3 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | 3 | creativecommons org publicdomain mark | creativecommons org publicdomain mark 1 0
cc-by-nc-nd-4.0 | 3 | cc by nc nd | cc by nc nd 4(?: 0)?
cc-by-nc-nd-3.0 | 3 | cc by nc nd | cc by nc nd 3(?: 0)?
cc-by-nc-nd | 2 | cc by nc nd | cc by nc nd
cc-by-nc-sa-4.0 | 3 | cc by nc sa | cc by nc sa 4(?: 0)?
cc-by-nc-sa-3.0 | 3 | cc by nc sa | cc by nc sa 3(?: 0)?
cc-by-nc-sa | 2 | cc by nc sa | cc by nc sa
cc-by-nc-4.0 | 3 | cc by nc | cc by nc 4(?: 0)?
cc-by-nc-3.0 | 3 | cc by nc | cc by nc 3(?: 0)?
cc-by-nc | 2 | cc by nc | cc by nc
cc-by-nd-4.0 | 3 | cc by nd | cc by nd 4(?: 0)?
cc-by-nd-3.0 | 3 | cc by nd | cc by nd 3(?: 0)?
cc-by-nd | 2 | cc by nd | cc by nd
cc-by-sa-4.0 | 3 | cc by sa | cc by sa 4(?: 0)?
cc-by-sa-3.0 | 3 | cc by sa | cc by sa 3(?: 0)?
cc-by-sa-2.5 | 3 | cc by sa | cc by sa 2 5
cc-by-sa | 2 | cc by sa | cc by sa
cc-by-4.0 | 3 | cc by 4 | cc by 4(?: 0)?
cc-by-3.0 | 3 | cc by 3 | cc by 3(?: 0)?
cc-by-2.0 | 3 | cc by 2 0 | cc by 2 0
cc-by-nc-nd-4.0 | 3 | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd | 2 | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd
cc-by-nc-sa-4.0 | 3 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa | 2 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa
cc-by-nc-4.0 | 3 | creativecommons org licenses by nc | creativecommons org licenses by nc 4 0
cc-by-nc | 2 | creativecommons org licenses by nc | creativecommons org licenses by nc
cc-by-sa-4.0 | 3 | creativecommons org licenses by sa | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 3 | creativecommons org licenses by sa | creativecommons org licenses by sa 3 0
cc-by-sa | 2 | creativecommons org licenses by sa | creativecommons org licenses by sa
cc-by-nd | 2 | creativecommons org licenses by nd | creativecommons org licenses by nd(?: [0-9] 0)?
cc-by-4.0 | 3 | creativecommons org licenses by 4 0 | creativecommons org licenses by 4 0
cc-by-3.0 | 3 | creativecommons org licenses by 3 0 | creativecommons org licenses by 3 0
cc-by | 2 | creativecommons org licenses by | creativecommons org licenses by
cc-by-nc-nd-4.0 | 3 | attribution non | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? 4 0
cc-by-nc-nd | 2 | attribution non | (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s(?: works)?
cc-by-nc-sa-4.0 | 3 | attribution non | creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-sa | 2 | attribution non | (?:creative commons )?attribution non ?commercial share ?alike
cc-by-nc-4.0 | 3 | attribution non | creative commons attribution non ?commercial 4 0
cc-by-nc | 2 | attribution non | creative commons attribution non ?commercial
cc-by-sa-4.0 | 3 | attribution share | creative commons attribution share ?alike 4 0
cc-by-sa-3.0 | 3 | attribution share | creative commons attribution share ?alike 3 0
cc-by-sa | 2 | attribution share | creative commons attribution share ?alike
cc-by-nd | 2 | attribution no | creative commons attribution no ?deriv(?:ative)?s
cc-by-4.0 | 3 | commons attribution 4 | creative commons attribution 4 0
cc-by-3.0 | 3 | commons attribution 3 | creative commons attribution 3 0
cc-by | 2 | creative commons attribution | creative commons attribution
creative-commons | 1 | creative commons | (?:a |the )?creative commons(?: licen[cs]e)?
public-domain | 3 | domain | (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
public-domain | 3 | domain | (?:is|are) (?:hereby )?in the public domain
public-domain | 1 | domain | public domain
copyleft | 1 | copyleft | copyleft
proprietary | 4 | unauthori | unauthori[sz]ed (?:copying|reproduction|distribution) of this (?:file|software|document|work|material) (?:via any medium )?is strictly prohibited
proprietary | 3 | proprietary and confidential | proprietary and confidential
proprietary | 3 | confidential and proprietary | confidential and proprietary
proprietary | 3 | may not be reproduced | may not be reproduced (?:stored |transmitted |distributed |in whole |in any form ).{0,80}?without (?:the )?(?:prior )?(?:express )?(?:written )?permission
proprietary | 3 | may be reproduced | no part of this (?:publication|book|document|work|site) may be reproduced
proprietary | 3 | end user licen | end user licen[cs]e agreement
proprietary | 2 | commercial licen | commercial licen[cs]e (?:is )?(?:required|agreement)
reserved | 2 | all rights reserved | all rights reserved
reserved | 2 | some rights reserved | some rights reserved
reserved | 2 | alle rechte vorbehalten | alle rechte vorbehalten
reserved | 2 | tous droits | tous droits r\S+s
reserved | 2 | todos los derechos reservados | todos los derechos reservados
copyright | 1 | copyright | copyright (?:c |\S{1,3} )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
clue-license | 1 | licensed under | (?:is |are )?licensed under(?: the| a| an)?
clue-license | 1 | licen | (?:see|read) (?:the )?licen[cs]e (?:file|txt|md)
clue-license | 1 | licen | (?:released|distributed|published|available) under (?:the |a |an )?(?:terms of (?:the |a )?)?(?:\S+ ){0,4}?licen[cs]e
clue-license | 1 | terms of use | (?:subject to |under )(?:the |our )?terms of use
"""


@dataclass(frozen=True)
class Rule:
    label: str
    level: int
    gate: str
    regex: str
    order: int


def parsed(table: str = RULES) -> list[Rule]:
    lines = [[part.strip() for part in line.split(" | ", 3)] for line in table.strip().splitlines()]
    return [Rule(label, int(level), gate, regex, i) for i, (label, level, gate, regex) in enumerate(lines)]


def compiled(rule: Rule) -> re.Pattern[str]:
    """Bounded by whole words on both sides."""
    return re.compile(rf"(?<![^ ])(?:{rule.regex.strip()})(?![^ ])")


def stem(rule: Rule) -> str | None:
    """A piece of a single word that a text with a match holds, however its words are parted; rules
    that start with the base phrase "cc by" go by that."""
    if rule.gate.startswith("cc by"):
        return None
    return "licen" if "licen" in rule.gate else max(rule.gate.split(), key=len)
