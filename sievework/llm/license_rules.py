"""Signature rules of licences: label | confidence | keyword that must be there | pattern.

Patterns see a text's words in lower case with one space between them, so signs and line breaks are spaces here
("Apache License, Version 2.0" is "apache license version 2 0"). Rules further up have priority over rules below.
"""

# Fixed values, hand-written: notices, titles, grants, short references, in order of priority.
WRITTEN = r"""
apache-2.0 | 0.99 | apache | licensed under the apache license version 2( 0)?( the license)?( you may not use this file except in compliance with the license)?
apache-2.0 | 0.98 | apache | apache license version 2 0( january 2004)?
apache-2.0 | 0.95 | apache | apache software license version 2( 0)?
apache-2.0 | 0.95 | apache | apache license 2 0
apache-2.0 | 0.9 | apache | apache 2( 0)? licen[sc]ed?
apache-2.0 | 0.9 | apache | www apache org licenses license 2 0
apache-1.1 | 0.97 | apache | apache (software )?license version 1 1
apache-1.0 | 0.97 | apache | apache (software )?license version 1 0
apache | 0.7 | apache | (under|of) the apache (software )?licen[sc]e
mit | 0.99 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 0.97 | mit | (released|licensed|distributed|available|provided) under the (terms of the )?mit licen[sc]e
mit | 0.95 | mit | the mit license mit
mit | 0.95 | opensource | opensource org licenses mit
mit | 0.9 | mit | (under|of) (the )?mit licen[sc]e
mit | 0.85 | mit | (the )?mit licensed?
mit-0 | 0.97 | mit | mit no attribution
x11 | 0.9 | x11 | (the )?x11 licen[sc]e
x11 | 0.9 | consortium | except as contained in this notice the name of the x consortium shall not be used
isc | 0.97 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 0.9 | isc | (the )?isc licen[sc]e
bsd-4-clause | 0.97 | advertising | all advertising materials mentioning features or use of this software must display
bsd-3-clause | 0.97 | endorse | neither the name of( the)? .{1,80}? nor the names of (its|any) contributors may be used to endorse
bsd-2-clause | 0.93 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | 0.95 | bsd | (3|three) clause bsd( licen[sc]e)?
bsd-3-clause | 0.95 | bsd | (new|modified|revised) bsd licen[sc]e
bsd-3-clause | 0.95 | bsd | bsd 3 clause( licen[sc]e)?
bsd-2-clause | 0.95 | bsd | (2|two) clause bsd( licen[sc]e)?
bsd-2-clause | 0.95 | bsd | (simplified|freebsd) bsd licen[sc]e
bsd-2-clause | 0.95 | bsd | bsd 2 clause( licen[sc]e)?
bsd-4-clause | 0.95 | bsd | (original|old|4 clause|four clause) bsd licen[sc]e
0bsd | 0.95 | bsd | (zero clause|0 clause) bsd( licen[sc]e)?
bsd | 0.8 | bsd | bsd (style )?licen[sc]ed?
agpl-3.0 | 0.98 | affero | gnu affero general public license( as published by the free software foundation)?( either)? (version 3|v3)( of the license)?( or (at your option )?any later version)?
agpl-3.0 | 0.95 | agpl | agpl ?v?3( 0)?( or later| only)?
agpl-1.0 | 0.95 | affero | affero general public license version 1
agpl | 0.9 | affero | (gnu )?affero general public licen[sc]e
agpl | 0.8 | agpl | (under|of) (the )?agpl
lgpl-3.0 | 0.98 | lesser | gnu (lesser|library) general public license( as published by the free software foundation)?( either)? (version 3|v3)( of the license)?( or (at your option )?any later version)?
lgpl-2.1 | 0.98 | lesser | gnu lesser general public license( as published by the free software foundation)?( either)? (version 2 1|v2 1)( of the license)?( or (at your option )?any later version)?
lgpl-2.0 | 0.98 | library | gnu library general public license( as published by the free software foundation)?( either)? (version 2|v2)( of the license)?( or (at your option )?any later version)?
lgpl-3.0 | 0.95 | lgpl | lgpl ?v?3( 0)?( or later| only)?
lgpl-2.1 | 0.95 | lgpl | lgpl ?v?2 1( or later| only)?
lgpl-2.0 | 0.93 | lgpl | lgpl ?v?2( 0)?( or later| only)?
lgpl | 0.9 | general | gnu (lesser|library) general public licen[sc]e
lgpl | 0.8 | lgpl | (under|of) (the )?(gnu )?lgpl
gpl-3.0 | 0.99 | general | (this work is |is )?(licensed|released|distributed) under (the terms of )?the gnu general public license( as published by the free software foundation)? (version 3|v3)( or (at your option )?any later version)?
gpl-2.0 | 0.99 | general | (this work is |is )?(licensed|released|distributed) under (the terms of )?the gnu general public license( as published by the free software foundation)? (version 2|v2)( or (at your option )?any later version)?
gpl-3.0 | 0.98 | general | gnu general public license( as published by the free software foundation)?( either)? (version 3|v3)( of the license)?( or (at your option )?any later version)?
gpl-2.0 | 0.98 | general | gnu general public license( as published by the free software foundation)?( either)? (version 2|v2)( of the license)?( or (at your option )?any later version)?
gpl-1.0 | 0.97 | general | gnu general public license( as published by the free software foundation)?( either)? version 1( of the license)?( or (at your option )?any later version)?
gpl-3.0 | 0.9 | general | general public licen[sc]e (version 3|v3)
gpl-2.0 | 0.9 | general | general public licen[sc]e (version 2|v2)
gpl-3.0 | 0.95 | gpl | (gnu )?gpl ?v?(ersion )?3( 0)?( or later| only)?
gpl-2.0 | 0.95 | gpl | (gnu )?gpl ?v?(ersion )?2( 0)?( or later| only)?
gpl-exception | 0.95 | exception | (gcc runtime library|classpath|autoconf|bison|font|linking) exception
gpl | 0.85 | general | (gnu )?general public licen[sc]e
gpl | 0.8 | gpl | (under|of) (the )?(gnu )?gpl
gfdl-1.3 | 0.97 | documentation | gnu free documentation license version 1 3( or any later version)?
gfdl-1.2 | 0.97 | documentation | gnu free documentation license version 1 2( or any later version)?
gfdl-1.1 | 0.97 | documentation | gnu free documentation license version 1 1( or any later version)?
gfdl | 0.9 | documentation | (gnu )?free documentation licen[sc]e
mpl-2.0 | 0.98 | mozilla | mozilla public license( v| version)? 2( 0)?
mpl-1.1 | 0.98 | mozilla | mozilla public license( v| version)? 1 1
mpl-1.0 | 0.98 | mozilla | mozilla public license( v| version)? 1 0
mpl-2.0 | 0.93 | mozilla | mozilla org mpl 2 0
mpl-2.0 | 0.93 | mpl | mpl ?v?2( 0)?
mpl | 0.85 | mozilla | mozilla public licen[sc]e
epl-2.0 | 0.98 | eclipse | eclipse public license( v| version)? ?2( 0)?
epl-1.0 | 0.98 | eclipse | eclipse public license( v| version)? ?1( 0)?
epl | 0.85 | eclipse | eclipse public licen[sc]e
edl-1.0 | 0.95 | eclipse | eclipse distribution licen[sc]e( v| version)?( 1 0)?
cddl-1.1 | 0.98 | development | common development and distribution license( v| version)? ?1 1
cddl-1.0 | 0.97 | development | common development and distribution license( v| version)?( 1 0)?
cddl | 0.85 | cddl | (under|of) (the )?cddl
cpl-1.0 | 0.95 | common | common public licen[sc]e( v| version)?( 1 0)?
eupl-1.2 | 0.97 | european | european union public licen[sc]e( v| version)? ?1 2
eupl-1.1 | 0.97 | european | european union public licen[sc]e( v| version)? ?1 1
eupl | 0.9 | european | european union public licen[sc]e
ms-pl | 0.95 | microsoft | microsoft public licen[sc]e
ms-rl | 0.95 | microsoft | microsoft reciprocal licen[sc]e
artistic-2.0 | 0.97 | artistic | artistic license( v| version)? ?2( 0)?
artistic-1.0 | 0.95 | artistic | artistic license( v| version)? ?1( 0)?
artistic | 0.85 | artistic | (the |perl )?artistic licen[sc]e
zlib | 0.97 | altered | altered source versions must be plainly marked as such
zlib | 0.9 | zlib | (the )?zlib (libpng )?licen[sc]e
libpng-2.0 | 0.93 | png | png reference library licen[sc]e( version 2)?
bsl-1.0 | 0.97 | boost | boost software license( version)?( 1 0)?
busl-1.1 | 0.97 | business | business source license( version)?( 1 1)?
sspl-1.0 | 0.97 | server | server side public license( version)?( 1)?
elastic-2.0 | 0.97 | elastic | elastic license( version)?( 2 0)?
polyform | 0.95 | polyform | polyform (noncommercial|small business|shield|strict|perimeter|free trial) license( 1 0 0)?
commons-clause | 0.95 | commons | commons clause( license condition)?( v1 0)?
unlicense | 0.98 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 0.93 | unlicense | (the )?unlicense( org)?
wtfpl | 0.95 | want | do what the fuck you want to public license
beerware | 0.95 | beer | the beer ?ware license
python-2.0 | 0.97 | python | python software foundation license( version 2)?
python-2.0 | 0.95 | python | psf license agreement for python
ruby | 0.9 | ruby | (same terms as|the) ruby (itself|licen[sc]e)
php-3.01 | 0.97 | php | php license( version)? 3 0?1
php-3.0 | 0.95 | php | (the )?php license( version 3 0)?
openssl | 0.97 | openssl | openssl (and ssleay )?licen[sc]es?
openssl | 0.9 | openssl | developed by the openssl project for use in the openssl toolkit
curl | 0.9 | curl | (the )?curl licen[sc]e
ofl-1.1 | 0.97 | font | sil open font license( version)?( 1 1)?
ubuntu-font | 0.95 | ubuntu | ubuntu font licen[sc]e( version 1 0)?
nasa-1.3 | 0.95 | nasa | nasa open source agreement( version)?( 1 3)?
ecl-2.0 | 0.95 | educational | educational community license( version)?( 2 0)?
afl-3.0 | 0.95 | academic | academic free license( v| version)? ?(3 0)?
osl-3.0 | 0.95 | open | open software license( v| version)? ?(3 0)?
ncsa | 0.95 | illinois | university of illinois (open source|ncsa open source) licen[sc]e
postgresql | 0.95 | postgresql | (the )?postgresql licen[sc]e
upl-1.0 | 0.95 | universal | universal permissive license( v| version)?( 1 0)?
vim | 0.95 | vim | (the )?vim licen[sc]e
w3c | 0.95 | w3c | w3c software (and document )?(notice and )?licen[sc]e
icu | 0.93 | icu | icu licen[sc]e icu
unicode | 0.95 | unicode | unicode (inc )?license agreement
cecill-2.1 | 0.96 | cecill | cecill (free software )?licen[sc]e( agreement)?( v| version)?( 2 1)?
blueoak-1.0 | 0.96 | oak | blue oak model license( 1 0 0)?
mulan-2 | 0.95 | mulan | mulan (permissive software|psl) licen[sc]e( v2| version 2)?
odbl-1.0 | 0.97 | database | open database licen[sc]e( v| version)?( 1 0)?
odc-by-1.0 | 0.97 | commons | open data commons attribution licen[sc]e( v| version)?( 1 0)?
pddl-1.0 | 0.97 | commons | (open data commons )?public domain dedication and licen[sc]e
ogl-uk-3.0 | 0.96 | government | open government licen[sc]e( v| version)? ?(3 0)?
etalab-2.0 | 0.95 | etalab | etalab (open licen[sc]e|licence ouverte)( 2 0)?
cc0-1.0 | 0.98 | cc0 | cc0( 1 0)?( universal)?( public domain dedication)?
cc0-1.0 | 0.97 | creative | creative commons (zero|public domain dedication)( v| version)?( 1 0)?( universal)?
cc-pdm | 0.95 | public | (creative commons )?public domain mark( 1 0)?
cc-by-nc-nd-4.0 | 0.99 | creative | creative commons attribution non ?commercial no ?deriv(ative)?s?( works)?( 4 0)?( international)?( public)? licen[sc]e
cc-by-nc-sa-4.0 | 0.99 | creative | creative commons attribution non ?commercial share ?alike( 4 0)?( international)?( public)? licen[sc]e
cc-by-nc-4.0 | 0.99 | creative | creative commons attribution non ?commercial( 4 0)?( international)?( public)? licen[sc]e
cc-by-nd-4.0 | 0.99 | creative | creative commons attribution no ?deriv(ative)?s?( works)?( 4 0)?( international)?( public)? licen[sc]e
cc-by-sa-4.0 | 0.99 | creative | creative commons attribution share ?alike( 4 0)?( international)?( public)? licen[sc]e
cc-by-4.0 | 0.98 | creative | creative commons attribution( 4 0)?( international)?( public)? licen[sc]e
cc-by-sa-3.0 | 0.98 | creative | creative commons attribution share ?alike 3 0( unported)?( licen[sc]e)?
cc-by-3.0 | 0.97 | creative | creative commons attribution 3 0( unported)?( licen[sc]e)?
cc | 0.75 | creative | (under a |a )?creative commons licen[sc]e
cc-url | 0.9 | creativecommons | creativecommons org licenses (by|by sa|by nc|by nd|by nc sa|by nc nd) [1-4] [05]
cc-url | 0.9 | creativecommons | creativecommons org publicdomain (zero|mark) 1 0
public-domain | 0.93 | domain | (dedicated|released|placed) (to|into|in) the public domain
public-domain | 0.8 | domain | (is|are) in the public domain
public-domain | 0.8 | copyrighted | this (work|document|software) is not copyrighted
apache-2.0 | 0.93 | apache | (this product includes|portions of this) software developed (at|by) the apache software foundation
apache-2.0 | 0.95 | limitations | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | 0.9 | as | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0-llvm | 0.97 | llvm | apache license v2 0 with llvm exceptions?
mit | 0.97 | notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 0.9 | warranty | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-modern | 0.9 | mit | modern (style )?mit licen[sc]e
mit-advertising | 0.93 | enlightenment | enlightenment licen[sc]e
expat | 0.93 | expat | (the )?expat licen[sc]e
isc | 0.9 | author | the software is provided as is and the author disclaims all warranties with regard to this software
hpnd | 0.93 | historical | historical permission notice and disclaimer
bsd-source-code | 0.93 | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | 0.9 | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | 0.93 | contributors | neither the name of the copyright holder nor the names of its contributors
bsd-3-clause-clear | 0.95 | clear | (the )?clear bsd licen[sc]e
bsd-1-clause | 0.95 | bsd | (1|one) clause bsd( licen[sc]e)?
bsd-patent | 0.95 | patent | bsd (2 clause )?plus patent licen[sc]e
bsd-protection | 0.93 | protection | bsd protection licen[sc]e
gpl | 0.93 | free | (this program is free software you can|you can) redistribute it and or modify it under the terms of the gnu general public license
gpl | 0.9 | useful | is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
gpl | 0.85 | copy | you should have received a copy of the gnu general public license along with this (program|library|work|software)
lgpl | 0.87 | copy | you should have received a copy of the gnu (lesser|library) general public license along with this (program|library|work|software)
agpl | 0.88 | copy | you should have received a copy of the gnu affero general public license along with this (program|library|work|software)
gpl | 0.9 | copyleft | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl-3.0-linking | 0.95 | linking | (gplv3|gpl 3) (with )?linking exception
gnu-all-permissive | 0.95 | copying | copying and distribution of this file with or without modification are permitted in any medium without royalty
gfdl | 0.95 | invariant | with no invariant sections( with)? no front cover texts and( with)? no back cover texts
mpl-2.0 | 0.97 | mpl | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | 0.93 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
npl-1.1 | 0.95 | netscape | netscape public license( version)?( 1 1)?
epl-2.0 | 0.95 | eclipse | (made available|accompanying materials are made available) under the terms of the eclipse public license( v)? 2 0
cecill-b | 0.95 | cecill | cecill b( free software)?( licen[sc]e)?
cecill-c | 0.95 | cecill | cecill c( free software)?( licen[sc]e)?
cpal-1.0 | 0.95 | attribution | common public attribution license( version)?( 1 0)?
ipl-1.0 | 0.95 | ibm | ibm public license( version)?( 1 0)?
apsl-2.0 | 0.95 | apple | apple public source license( version)?( 2 0)?
rpl-1.5 | 0.95 | reciprocal | reciprocal public license( version)?( 1 5)?
rpsl-1.0 | 0.95 | realnetworks | realnetworks public source license( v1 0)?
qpl-1.0 | 0.95 | public | (the )?q public license( version)?( 1 0)?
spl-1.0 | 0.93 | sun | sun public license( version)?( 1 0)?
sissl | 0.93 | industry | sun industry standards source license
lppl-1.3c | 0.96 | latex | latex project public license( version)?( 1 3c?)?( or (at your option )?any later version)?
osl-3.0 | 0.93 | open | licensed under the open software license version 3 0
sleepycat | 0.95 | sleepycat | (the )?sleepycat licen[sc]e
oldap-2.8 | 0.95 | openldap | openldap public license( version)?( 2 8)?
zpl-2.1 | 0.95 | zope | zope public license( zpl)?( version)?( 2 1)?
ijg | 0.95 | jpeg | this software is based in part on the work of the independent jpeg group
ftl | 0.95 | freetype | (the )?freetype (project )?licen[sc]e
imagemagick | 0.95 | imagemagick | imagemagick licen[sc]e
cube | 0.9 | cube | cube game engine source code license
json | 0.95 | evil | the software shall be used for good not evil
bittorrent-1.1 | 0.95 | bittorrent | bittorrent open source license( version)?( 1 1)?
watcom-1.0 | 0.95 | watcom | sybase open watcom public license( version)?( 1 0)?
intel | 0.9 | intel | intel (open source|simplified software) licen[sc]e
nvidia | 0.9 | nvidia | nvidia (software|source code) licen[sc]e( agreement)?
oracle-bcl | 0.93 | oracle | oracle binary code license agreement
otn | 0.93 | oracle | oracle technology network (developer )?licen[sc]e( agreement)?
unrar | 0.93 | unrar | unrar (source )?(licen[sc]e|restriction)
info-zip | 0.95 | zip | info zip licen[sc]e
bzip2 | 0.93 | bzip2 | bzip2 (and libbzip2 )?licen[sc]e
tcl | 0.93 | tcl | tcl tk licen[sc]e
hippocratic | 0.95 | hippocratic | hippocratic license( version)?( [123] [01])?
anti-996 | 0.95 | 996 | anti 996 license
parity-7.0 | 0.95 | parity | parity public license( 7 0 0)?
prosperity-3.0 | 0.95 | prosperity | prosperity public license( 3 0 0)?
fsl-1.1 | 0.95 | functional | functional source license( version)?( 1 1)?
confluent | 0.95 | confluent | confluent community license( agreement)?( version 1 0)?
timescale | 0.95 | timescale | timescale license( agreement)?
openrail | 0.95 | rail | (open|creativeml open|bigscience)( responsible ai)?( licen[sc]es?)? rail( m)?( licen[sc]e)?
llama | 0.95 | llama | llama [234]? ?(\d )?community licen[sc]e( agreement)?
gemma | 0.93 | gemma | gemma (terms of use|licen[sc]e)
dl-de-by-2.0 | 0.95 | datenlizenz | datenlizenz deutschland namensnennung( version)? 2 0
odc-odbl | 0.93 | database | made available under the open database licen[sc]e
cdla-permissive | 0.95 | community | community data license agreement permissive( version)?( [12] 0)?
cdla-sharing | 0.95 | community | community data license agreement sharing( version)?( 1 0)?
fal-1.3 | 0.95 | art | (free art license|licence art libre)( 1 3)?
ogl-canada | 0.95 | canada | open government licen[sc]e canada
eu-decision | 0.85 | reuse | reuse is authori[sz]ed provided the source is acknowledged
us-government-work | 0.9 | government | (is|are) (a )?works? of the (united states|u s|us) government
crown-copyright | 0.9 | crown | crown copyright( (19|20)[0-9]{2})?
reservados | 0.9 | derechos | todos los derechos reservados
reserves | 0.9 | droits | tous droits réservés
vorbehalten | 0.9 | rechte | alle rechte vorbehalten
riservati | 0.9 | diritti | tutti i diritti riservati
proprietary | 0.93 | confidential | (proprietary and confidential|confidential and proprietary)
proprietary | 0.93 | prohibited | unauthori[sz]ed (copying|reproduction|distribution|use)( or distribution)?( of this (file|document|work|software))?( via any medium)? is (strictly )?prohibited
proprietary | 0.9 | reproduced | no part of this (publication|work|book|document) may be reproduced
proprietary | 0.9 | permission | may not be (copied|reproduced|redistributed)( or (distributed|transmitted))? without (the )?(prior )?(express )?(written )?permission
proprietary | 0.9 | evaluation | for (internal|evaluation) (use|purposes) only
proprietary | 0.85 | end | end user licen[sc]e agreement
proprietary | 0.8 | commercial | (a )?commercial licen[sc]e (is )?required
non-commercial | 0.9 | commercial | (for )?(non commercial|noncommercial) (use|purposes) only
non-commercial | 0.85 | research | (for )?(academic|research) (use|purposes) only
all-rights-reserved | 0.9 | reserved | (copyright )?(c )?([12][0-9]{3} )?([a-z0-9]+ ){0,4}?all rights (are )?reserved
some-rights-reserved | 0.8 | reserved | some rights reserved
copyright-notice | 0.6 | copyright | copyright (c )?(19|20)[0-9]{2}( (19|20)[0-9]{2})?( by)?
copyright-notice | 0.5 | copyrighted | copyrighted (by|material)
"""

# Short forms of Creative Commons, and identifiers of the SPDX list; a rule each is made below.
CC_PARTS = ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")
CC_VERSIONS = ("4 0", "3 0", "2 5", "2 0", "1 0")
SPDX = """AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 Beerware
BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause 0BSD BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0
CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2
GFDL-1.2-only GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ICU IJG IPL-1.0 ISC
LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later Libpng LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NIST-PD NPL-1.1 ODbL-1.0 ODC-By-1.0 OFL-1.1
OLDAP-2.8 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()


def _words(name: str) -> str:
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in name).split())


def rules() -> list[tuple[str, float, bytes, str]]:
    """(label, confidence, keyword, pattern) by falling priority."""
    out = [(f"spdx:{i.lower()}", 1.0, b"spdx", f"spdx license identifier {_words(i)}") for i in sorted(SPDX, key=lambda s: -len(s))]
    written = [tuple(x.strip() for x in line.split(" | ", 3)) for line in WRITTEN.strip().splitlines()]
    out += [(a, float(b), c.encode(), d) for a, b, c, d in written]
    out += [(f"cc-{p.replace(' ', '-')}-{v.replace(' ', '.')}", 0.95, f"cc {p}".encode(), f"(licensed under )?cc {p} {v}( international)?") for p in CC_PARTS for v in CC_VERSIONS]
    out += [(f"cc-{p.replace(' ', '-')}", 0.8, f"cc {p}".encode(), f"(licensed under )?cc {p}") for p in CC_PARTS]
    return out
