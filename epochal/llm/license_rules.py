"""Signatures of licenses over words: one line a rule, label, role and expression.

Texts are lower-cased words with a blank between them, so punctuation never shows: ``GPL-2.0+`` is ``gpl 2 0``.
Roles, from the strongest: ``id`` an SPDX identifier, ``text`` a sentence of the license itself, ``url`` its address,
``grant`` a notice that puts something under it, ``name`` its full name, ``title`` a short name beside the word
license, ``mention`` a code that means the license alone.
"""

from __future__ import annotations

#: What licenses, notices, identifiers and addresses say. Within a role longer matches win.
SIGNATURES = """
mit id spdx license identifier (?:mit|expat)
mit text permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit text to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit text the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit url (?:https? )?(?:www )?opensource org licen[cs]es? mit(?: license(?: php)?)?
mit url choosealicense com licenses mit
mit grant (?:licensed|released|distributed|available|published|provided|redistributed|offered|made available)(?: to you)? under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:mit|expat|x11)(?: x11| expat)?(?: style)?(?: open source)?(?: license| licence| terms)?
mit grant (?:subject to|governed by|covered by|in accordance with|use of this .{1,40} is governed by) (?:the )?(?:terms of )?(?:the |an )?mit(?: style)? licen[cs]e
mit grant (?:is|are) (?:mit|expat) licensed
mit name (?:the )?mit licen[cs]e(?: mit)?
mit name (?:the )?(?:expat|x11) licen[cs]e
mit title licen[cs]e mit
mit title mit style licen[cs]e
mit-0 id spdx license identifier mit 0
mit-0 name mit no attribution(?: licen[cs]e)?
apache-2 id spdx license identifier apache 2 0
apache-2 text licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 text terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions
apache-2 text each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2 url (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2 url opensource org licen[cs]es? apache 2 0
apache-2 grant (?:licensed|released|distributed|available|published|provided|redistributed)(?: to you)? under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?(?: license| licence)?
apache-2 grant (?:subject to|governed by|covered by|in accordance with) (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?
apache-2 name (?:the )?apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?
apache-2 name apache(?: version)? 2(?: 0)? licen[cs]e
apache-2 title licen[cs]e apache(?: licen[cs]e)? 2(?: 0)?
apache-2 mention (?:asl 2 0|asl2 0|apache 2 0|apachev2|apache v2)
apache-1 id spdx license identifier apache 1(?: [01])
apache-1 text this product includes software developed by the apache (?:group|software foundation)
apache-1 text products derived from this software may not be called apache nor may apache appear in their names?
apache-1 url (?:www )?apache org licenses license 1(?: [01])
apache-1 name (?:the )?apache(?: software)? licen[cs]e(?: version| v)? 1(?: [01])?
apache-1 title licen[cs]e apache 1 [01]
apache name (?:the )?apache software licen[cs]e
bsd-2 id spdx license identifier bsd 2 clause(?: patent| views| freebsd)?
bsd-2 url (?:opensource|spdx) org licen[cs]es? bsd 2 clause
bsd-2 grant (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?
bsd-2 grant (?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd) licen[cs]e
bsd-2 name (?:the )?(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: simplified)? licen[cs]e
bsd-2 title licen[cs]e bsd 2 clause
bsd-3 id spdx license identifier bsd 3 clause(?: clear| lbnl| modification)?
bsd-3 text neither the names? of .{1,80} nor the names of (?:its|any|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3 url (?:opensource|spdx) org licen[cs]es? bsd 3 clause
bsd-3 grant (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?
bsd-3 grant (?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) licen[cs]e
bsd-3 name (?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: new| revised)? licen[cs]e
bsd-3 title licen[cs]e bsd 3 clause
bsd-4 id spdx license identifier bsd 4 clause(?: uc)?
bsd-4 text all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4 name (?:the )?(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd|bsd original) licen[cs]e
bsd-4 title licen[cs]e bsd 4 clause
bsd text redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd text redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice this list of conditions and the following disclaimer
bsd grant (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the |a )?bsd(?: style)?(?: licen[cs]e)?
bsd grant use of this source code is governed by a bsd style licen[cs]e(?: that can be found in the license file)?
bsd name (?:the )?bsd licen[cs]e
bsd title bsd style licen[cs]e
0bsd id spdx license identifier 0bsd
0bsd text permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
0bsd name (?:0bsd|zero clause bsd|bsd zero clause|0 clause bsd)(?: licen[cs]e)?
isc id spdx license identifier isc
isc text permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc url opensource org licen[cs]es? isc(?: license)?
isc grant (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?isc(?: licen[cs]e)?
isc name (?:the )?isc licen[cs]e
isc title licen[cs]e isc
gpl-1 id spdx license identifier gpl 1 0(?: only| or later)?
gpl-1 name (?:the )?(?:gnu )?general public licen[cs]e(?: version| v)? ?1(?: 0)?
gpl-2 id spdx license identifier gpl 2 0(?: only| or later)?(?: with [a-z0-9]+ exception(?: [0-9] [0-9])?)?
gpl-2 text gnu general public license version 2 june 1991
gpl-2 text published by the free software foundation either version 2 of the license or at your option any later version
gpl-2 text terms of the gnu general public license version 2 (?:only )?as published by the free software foundation
gpl-2 url (?:www )?gnu org licenses(?: old licenses)? gpl 2 0(?: html| txt| en html)?
gpl-2 grant (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?2(?: 0)?(?: only| or later| or any later version)?
gpl-2 name (?:the )?(?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? ?2(?: 0)?(?: only| or later)?
gpl-2 title (?:gnu )?gpl(?: version| v)? ?2(?: 0)?(?: only| or later)?(?: licen[cs]e)
gpl-2 mention (?:gplv2|gpl v2|gpl 2 0)
gpl-3 id spdx license identifier gpl 3 0(?: only| or later)?(?: with [a-z0-9]+ exception(?: [0-9] [0-9])?)?
gpl-3 text gnu general public license version 3 29 june 2007
gpl-3 text published by the free software foundation either version 3 of the license or at your option any later version
gpl-3 url (?:www )?gnu org licenses gpl(?: 3 0)?(?: html| txt| en html)?
gpl-3 grant (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?3(?: 0)?(?: only| or later| or any later version)?
gpl-3 name (?:the )?(?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? ?3(?: 0)?(?: only| or later)?
gpl-3 title (?:gnu )?gpl(?: version| v)? ?3(?: 0)?(?: only| or later)?(?: licen[cs]e)
gpl-3 mention (?:gplv3|gpl v3|gpl 3 0)
gpl text this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl text you should have received a copy of the gnu general public license along with this program
gpl text this (?:program|library|software) is distributed in the hope that it will be useful but without any warranty
gpl grant (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e)
gpl grant (?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e)
gpl name (?:the )?gnu general public licen[cs]e(?: gpl)?
gpl title (?:the )?(?:gnu )?gpl licen[cs]e
gpl title licen[cs]e(?:d under)? (?:the )?(?:gnu )?gpl
lgpl-2 id spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2 text gnu library general public license version 2 june 1991
lgpl-2 name (?:the )?(?:gnu )?library general public licen[cs]e(?: version| v)?(?: 2(?: 0)?)?
lgpl-2.1 id spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 text gnu lesser general public license version 2 1 february 1999
lgpl-2.1 text lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-2.1 url (?:www )?gnu org licenses(?: old licenses)? lgpl 2 1(?: html| txt)?
lgpl-2.1 name (?:the )?(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1
lgpl-2.1 mention (?:lgplv2 1|lgpl v2 1|lgpl 2 1)
lgpl-3 id spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 text gnu lesser general public license version 3 29 june 2007
lgpl-3 url (?:www )?gnu org licenses lgpl(?: 3 0)?(?: html| txt)?
lgpl-3 name (?:the )?(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?
lgpl-3 mention (?:lgplv3|lgpl v3|lgpl 3 0)
lgpl text this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl text you should have received a copy of the gnu lesser general public license along with this library
lgpl grant (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public licen[cs]e)
lgpl name (?:the )?(?:gnu )?lesser general public licen[cs]e
lgpl title (?:the )?(?:gnu )?lgpl(?:v?[23])? licen[cs]e
agpl-3 id spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 text gnu affero general public license version 3 19 november 2007
agpl-3 url (?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
agpl-3 grant (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:agpl|affero general public licen[cs]e)(?: version| v)?(?: ?3(?: 0)?)?
agpl-3 name (?:the )?(?:gnu )?affero general public licen[cs]e(?: version| v)?(?: ?3(?: 0)?)?
agpl-3 title (?:gnu )?agpl(?:v?3)? licen[cs]e
agpl-3 mention (?:agplv3|agpl v3|agpl 3 0)
gfdl id spdx license identifier gfdl 1 [123](?: only| or later)?
gfdl text permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl url (?:www )?gnu org (?:licenses|copyleft) fdl(?: 1 3)?(?: html| txt)?
gfdl name (?:the )?gnu free documentation licen[cs]e
mpl-1.1 id spdx license identifier mpl 1 [01]
mpl-1.1 text the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 name (?:the )?mozilla public licen[cs]e(?: mpl)?(?: version| v)? 1 [01]
mpl-2 id spdx license identifier mpl 2 0(?: no copyleft exception)?
mpl-2 text this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 text if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2 url (?:www )?mozilla org (?:en us )?mpl 2 0
mpl-2 grant (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e(?: version| v)?(?: 2(?: 0)?)
mpl-2 name (?:the )?mozilla public licen[cs]e(?: mpl)?(?: version| v)? 2(?: 0)?(?: for details)?
mpl-2 title licen[cs]e mpl 2 0
mpl name (?:the )?mozilla public licen[cs]e
epl-1 id spdx license identifier epl 1 0
epl-1 text accompanying program is provided under the terms of this eclipse public license
epl-1 url (?:www )?eclipse org legal epl v10(?: html)?
epl-1 name (?:the )?eclipse public licen[cs]e(?: version| v)? 1(?: 0)?
epl-2 id spdx license identifier epl 2 0
epl-2 url (?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?
epl-2 text this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? ?2 0
epl-2 name (?:the )?eclipse public licen[cs]e(?: version| v)? 2(?: 0)?
epl name (?:the )?eclipse public licen[cs]e
cpl-1 id spdx license identifier cpl 1 0
cpl-1 name (?:the )?common public licen[cs]e(?: version| v)?(?: 1 0)?
cddl-1 id spdx license identifier cddl 1 [01]
cddl-1 text the contents of this file are subject to the terms of the common development and distribution license
cddl-1 name (?:the )?common development and distribution licen[cs]e(?: cddl)?(?: version| v)?(?: 1 [01])?
cddl-1 grant (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?cddl(?: 1 [01])?
cddl-1 mention cddl 1 [01]
cddl-1 title cddl licen[cs]e
zlib id spdx license identifier zlib(?: acknowledgement)?
zlib text this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib text altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib name (?:the )?zlib(?: libpng)? licen[cs]e
libpng id spdx license identifier libpng(?: 2 0)?
libpng name (?:the )?(?:png reference library|libpng) licen[cs]e
boost id spdx license identifier bsl 1 0
boost text permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
boost url (?:www )?boost org license 1 0 txt
boost grant distributed under the boost software license version 1 0
boost name (?:the )?boost software licen[cs]e(?: version| v)?(?: 1 0)?
bsl-1.1 id spdx license identifier busl 1 1
bsl-1.1 name (?:the )?business source licen[cs]e(?: version| v)?(?: 1 1)?
unlicense id spdx license identifier unlicense
unlicense text this is free and unencumbered software released into the public domain
unlicense text anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
unlicense url (?:www )?unlicense org
unlicense name the unlicense
wtfpl id spdx license identifier wtfpl
wtfpl text you just do what the fuck you want to
wtfpl name do what the fuck you want to public licen[cs]e
wtfpl mention wtfpl
cc0 id spdx license identifier cc0 1 0
cc0 text the person who associated a work with this deed has dedicated the work to the public domain
cc0 text to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights to
cc0 url creativecommons org publicdomain zero 1 0(?: legalcode)?
cc0 name (?:the )?(?:cc0|creative commons zero|creative commons cc0)(?: 1 0)?(?: universal)?(?: public domain dedication)?(?: licen[cs]e)?
public-domain grant (?:released|dedicated|placed|put) (?:in|into|to) the public domain
public-domain url creativecommons org publicdomain mark 1 0
public-domain name public domain dedication
cc-by id spdx license identifier cc by [1-4] [05]
cc-by text you are free to share copy and redistribute the material in any medium or format
cc-by url creativecommons org licenses by [1-4] [05]
cc-by grant (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of )?(?:the |a )?(?:creative commons attribution|cc by)(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by name creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by mention cc by [1-4] [05]
cc-by-sa id spdx license identifier cc by sa [1-4] [05]
cc-by-sa url creativecommons org licenses by sa [1-4] [05]
cc-by-sa text if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-sa grant (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of )?(?:the |a )?(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-sa name creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-sa mention cc by sa(?: [1-4] [05])?
cc-by-nd id spdx license identifier cc by nd [1-4] [05]
cc-by-nd url creativecommons org licenses by nd [1-4] [05]
cc-by-nd text if you remix transform or build upon the material you may not distribute the modified material
cc-by-nd name creative commons attribution no ?deriv(?:ative|ative work)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nd mention cc by nd(?: [1-4] [05])?
cc-by-nc id spdx license identifier cc by nc [1-4] [05]
cc-by-nc url creativecommons org licenses by nc [1-4] [05]
cc-by-nc text you may not use the material for commercial purposes
cc-by-nc grant (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of )?(?:the |a )?(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc name creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nc mention cc by nc [1-4] [05]
cc-by-nc-sa id spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-sa url creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-sa grant (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of )?(?:the |a )?(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-sa name creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nc-sa mention cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd id spdx license identifier cc by nc nd [1-4] [05]
cc-by-nc-nd url creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-nd name creative commons attribution non ?commercial no ?deriv(?:ative|ative work)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
cc-by-nc-nd mention cc by nc nd(?: [1-4] [05])?
artistic-1 id spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-1 text the intent of this document is to state the conditions under which a package may be copied
artistic-1 name (?:the )?artistic licen[cs]e(?: version| v)? 1(?: 0)?
artistic-2 id spdx license identifier artistic 2 0
artistic-2 text this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic-2 name (?:the )?artistic licen[cs]e(?: version| v)? 2(?: 0)?
artistic name (?:the )?(?:perl )?artistic licen[cs]e
perl text this library is free software you can redistribute it and or modify it under the same terms as perl itself
perl grant same terms as (?:perl|the perl 5 programming language)(?: itself)?
python-2 id spdx license identifier (?:python|psf) 2 0(?: 1)?
python-2 text this license agreement is between the python software foundation psf and the individual or organization licensee
python-2 name (?:the )?python software foundation licen[cs]e(?: version 2)?
python-2 title psf licen[cs]e
php-3 id spdx license identifier php 3 (?:0|01)
php-3 text this product includes php software freely available from
php-3 name (?:the )?php licen[cs]e(?: version| v)?(?: 3 (?:0|01))?
ruby id spdx license identifier ruby
ruby name (?:the )?ruby licen[cs]e
ruby grant (?:same|under the) terms as ruby(?: itself)?
openssl id spdx license identifier openssl
openssl text this product includes software developed by the openssl project for use in the openssl toolkit
openssl name (?:the )?openssl(?: ssleay)? licen[cs]e
ms-pl id spdx license identifier ms pl
ms-pl name (?:the )?microsoft public licen[cs]e(?: ms pl)?
ms-rl id spdx license identifier ms rl
ms-rl name (?:the )?microsoft reciprocal licen[cs]e(?: ms rl)?
eupl-1.2 id spdx license identifier eupl 1 [12]
eupl-1.2 text licensed under the eupl(?: version)?(?: 1 [12])?
eupl-1.2 name (?:the )?european union public licen[cs]e(?: version| v)?(?: ?1 [12])?
osl-3 id spdx license identifier osl 3 0
osl-3 text licensed under the open software license version 3 0
osl-3 name (?:the )?open software licen[cs]e(?: osl)?(?: version| v)?(?: ?3(?: 0)?)?
afl-3 id spdx license identifier afl 3 0
afl-3 text licensed under the academic free license version 3 0
afl-3 name (?:the )?academic free licen[cs]e(?: afl)?(?: version| v)?(?: ?3(?: 0)?)?
ecl-2 id spdx license identifier ecl 2 0
ecl-2 name (?:the )?educational community licen[cs]e(?: version| v)?(?: 2 0)?
ofl-1.1 id spdx license identifier ofl 1 1(?: rfn| no rfn)?
ofl-1.1 text this font software is licensed under the sil open font license version 1 1
ofl-1.1 url scripts sil org ofl
ofl-1.1 name (?:the )?(?:sil )?open font licen[cs]e(?: ofl)?(?: version| v)?(?: 1 1)?
odbl id spdx license identifier odbl 1 0
odbl url opendatacommons org licenses odbl(?: 1 0)?
odbl name (?:the )?(?:open data commons )?open database licen[cs]e(?: odbl)?(?: version| v)?(?: 1 0)?
odc-by id spdx license identifier odc by 1 0
odc-by name (?:the )?open data commons attribution licen[cs]e(?: version| v)?(?: 1 0)?
pddl id spdx license identifier pddl 1 0
pddl name (?:open data commons )?public domain dedication and licen[cs]e(?: pddl)?
upl id spdx license identifier upl 1 0
upl name (?:the )?universal permissive licen[cs]e(?: version| v)?(?: 1 0)?
ncsa id spdx license identifier ncsa
ncsa name (?:the )?university of illinois(?: ncsa)? open source licen[cs]e
postgresql id spdx license identifier postgresql
postgresql name (?:the )?postgresql licen[cs]e
sspl id spdx license identifier sspl 1 0
sspl name (?:the )?server side public licen[cs]e(?: version| v)?(?: 1)?
elastic-2 id spdx license identifier elastic 2 0
elastic-2 name (?:the )?elastic licen[cs]e(?: version| v)?(?: 2(?: 0)?)?
w3c id spdx license identifier w3c(?: 19980720| 20150513)?
w3c name (?:the )?w3c software(?: and document)?(?: notice and)? licen[cs]e
unicode id spdx license identifier unicode (?:3 0|dfs 2015|dfs 2016|tou)
unicode name unicode(?: inc)? licen[cs]e agreement(?: data files and software)?
qpl id spdx license identifier qpl 1 0
qpl name (?:the )?q public licen[cs]e(?: version| v)?(?: 1 0)?
cecill id spdx license identifier cecill (?:1 0|1 1|2 0|2 1|b|c)
cecill name (?:the )?cecill(?: [abc]| v2(?: 1)?)?(?: free software)? licen[cs]e(?: agreement)?
mulan-2 id spdx license identifier mulanpsl 2 0
mulan-2 name (?:the )?mulan permissive software licen[cs]e(?: version| v)?(?: ?2)?
openrail name (?:creativeml |bigscience )?open ?rail(?: [m+]+)?(?: licen[cs]e)
llama name llama [234](?: [0-9])? community licen[cs]e(?: agreement)?
proprietary text all rights reserved unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document) via any medium is strictly prohibited
proprietary text this (?:software|document) (?:is|contains) (?:the )?(?:proprietary and )?confidential (?:and proprietary )?(?:information|property) of
proprietary grant proprietary and confidential
"""
