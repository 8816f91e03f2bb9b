"""Hand-written signatures of licenses: sentences of their texts, headers, titles and short names.

A line is: label, keyword, kind, pattern. The keyword is a word that every match holds. In a
pattern a blank stands for white space and comment marks, a comma may be missing.
"""

from __future__ import annotations

#: Kind -> priority and confidence.
KINDS = {"text": (75, 0.9), "header": (78, 0.92), "title": (62, 0.7), "short": (45, 0.6), "link": (60, 0.75)}

#: The signatures.
SIGNATURES = r"""
mit | hereby | text | permission is hereby granted, free of charge, to any person obtaining a copy(?! or)
mit | sublicense | text | to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software
mit | substantial | text | the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software
mit | limitation | text | without restriction, including without limitation the rights to use, copy, modify
mit | noninfringement | text | merchantability, fitness for a particular purpose and noninfringement
mit | dealings | text | arising from, out of or in connection with the software or the use or other dealings in the software
mit-0 | attribution | title | mit no attribution
mit-0 | mit-0 | short | mit-0
mit | x11 | title | (?:mit/x11|x11) licen[cs]e
mit | mit | short | mit-licen[cs]ed
mit | mit | header | released under (?:an?|the) mit-style licen[cs]e
bsd | redistribution | text | redistribution and use in source and binary forms, with or without modification, are permitted
bsd | redistributions | text | redistributions of source code must retain the (?:above )?copyright notice, this list of conditions and the following disclaimer
bsd | redistributions | text | redistributions in binary form must reproduce the (?:above )?copyright notice, this list of conditions and the following disclaimer
bsd-3-clause | endorse | text | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | neither | text | neither the name of .{1,80}? nor the names of its contributors may be used
bsd-4-clause | advertising | text | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | exemplary | text | in no event shall .{1,120}? be liable for any direct, indirect, incidental, special, exemplary, or consequential damages
bsd | bsd-licensed | short | bsd-licensed
bsd-2-clause | freebsd | title | freebsd licen[cs]e
bsd-0 | 0bsd | short | (?:0bsd|zero-clause bsd)
bsd-4-clause | bsd | title | (?:original|4-clause|four-clause) bsd(?: licen[cs]e)?
bsd-3-clause-clear | clear | title | clear bsd licen[cs]e
isc | distribute | text | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
isc | tortious | text | an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software
bsd-0 | distribute | text | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided
hpnd | advertising | text | not be used in advertising or publicity pertaining to distribution of the software without specific, written prior permission
apache-2.0 | apache | header | licensed under the apache license, version 2\.0
apache | asf | header | licensed to the apache software foundation \(asf\) under one or more contributor license agreements
apache-2.0 | compliance | text | you may not use this file except in compliance with the license
apache-2.0 | limitations | text | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | agreed | text | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "?as is"? basis
apache-2.0 | royalty-free | text | each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license
apache-2.0 | patent | text | irrevocable \(except as stated in this section\) patent license to make, have made, use, offer to sell, sell, import
apache-2.0 | reproduction | title | terms and conditions for use, reproduction, and distribution
apache-1.1 | foundation | text | this product includes software developed by the apache software foundation
apache-2.0 | apache2 | short | apache2(?:\.0)?
apache-2.0 | apache-2 | short | apache-2(?:\.0)?
apache-2.0 | asl | short | asl 2\.0
apache-2.0 | al2 | short | al2
gpl | redistribute | header | this program is free software[:;]? you can redistribute it and/or modify it under the terms of the gnu general public license
gpl | hope | header | this program is distributed in the hope that it will be useful, but without any warranty
gpl | received | header | you should have received a copy of the gnu general public license along with
gpl-2 | version | header | either version 2 of the license, or \(at your option\) any later version
gpl-3 | version | header | either version 3 of the license, or \(at your option\) any later version
gpl-3 | gplv3 | short | (?:gnu )?gplv3(?:\+| or later| only)?
gpl-2 | gplv2 | short | (?:gnu )?gplv2(?:\+| or later| only)?
gpl-1 | gplv1 | short | (?:gnu )?gplv1\+?
gpl-3 | copyleft | text | the gnu general public license is a free, copyleft license for software and other kinds of works
gpl | designed | text | the licenses for most software are designed to take away your freedom to share and change
gpl-2 | refers | text | the "program", below, refers to any such program or work
gpl-3 | propagate | text | to "propagate" a work means to do anything with it that, without permission, would make you directly or secondarily liable
gpl-3 | convey | text | you may convey verbatim copies of the program's source code as you receive it
gpl | linking | title | gpl linking exception
gpl | classpath | title | (?:gnu )?classpath exception
gpl | gpl-compatible | short | gpl-compatible
gpl | gpl'd | short | gpl'd
gpl | gpled | short | gpled
lgpl | redistribute | header | this library is free software[:;]? you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | library | header | you should have received a copy of the gnu (?:lesser|library) general public license along with this
lgpl-2.1 | version | header | either version 2\.1 of the license, or \(at your option\) any later version
lgpl | lesser | text | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
lgpl | library | text | a "work based on the library" means either the library or any derivative work under copyright law
lgpl-3 | lgplv3 | short | lgplv3(?:\+| or later| only)?
lgpl-2.1 | lgplv2 | short | lgplv2(?:\.1)?(?:\+| or later| only)?
agpl | affero | header | under the terms of the gnu affero general public license
agpl | remotely | text | your modified version must prominently offer all users interacting with it remotely through a computer network
agpl | affero | text | the gnu affero general public license is a free, copyleft license
agpl-3 | agplv3 | short | agplv3(?:\+| or later| only)?
gfdl | invariant | text | with no invariant sections, no front-cover texts, and no back-cover texts
gfdl | documentation | header | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license
gfdl | gfdl | short | gfdl(?: ?1\.[0-3])?
mpl-2.0 | mozilla | header | this source code form is subject to the terms of the mozilla public license, v\. ?2\.0
mpl-2.0 | mpl | header | if a copy of the mpl was not distributed with this file, you can obtain one at
mpl-1.1 | mozilla | header | the contents of this file are subject to the mozilla public license version 1\.1
mpl-1.1 | rights | text | software distributed under the license is distributed on an "as is" basis, without warranty of any kind, either express(?:ed)? or implied\. see the license for the specific language governing rights
mpl-2.0 | secondary | text | "incompatible with secondary licenses"
mpl-2.0 | mplv2 | short | mplv2(?:\.0)?
mpl | mpl | short | mpl ?(?:1\.[01]|2\.0)
epl | eclipse | header | this program and the accompanying materials are made available under the terms of the eclipse public license
epl-2.0 | eclipse | header | eclipse public license v?\.? ?2\.0
epl-1.0 | eclipse | header | eclipse public license v?\.? ?1\.0
epl | agreement | text | any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement
epl | epl | short | epl-?[12]\.0
cpl | common | title | common public license(?: version)? ?1\.0
ipl | ibm | title | ibm public license
cddl | distribution | header | the contents of this file are subject to the terms of the common development and distribution license
cddl | cddl | short | cddl(?:-| )1\.[01]
cddl | cddl | header | by this cddl header
eupl | eupl | header | licensed under the eupl
eupl | eupl | short | eupl(?:-| v?\.? ?)1\.[012]
bsl | organization | text | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
bsl | boost | header | distributed under the boost software license, version 1\.0
bsl | machine-executable | text | solely in the form of machine-executable object code generated by a source language processor
busl | business | title | business source license(?: 1\.1)?
busl | change | text | effective on the change date, or the fourth anniversary
zlib | misrepresented | text | the origin of this software must not be misrepresented
zlib | altered | text | altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
zlib | warranty | text | this software is provided 'as-is', without any express or implied warranty
libpng | libpng | title | libpng licen[cs]e
unlicense | unencumbered | text | this is free and unencumbered software released into the public domain
unlicense | dedicate | text | dedicate any and all copyright interest in the software to the public domain
unlicense | detriment | text | for the benefit of the public at large and to the detriment of our heirs and successors
wtfpl | verbatim | text | everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed
wtfpl | want | text | you just do what the \w+ you want to
beerware | beer | text | if we meet some day, and you think this stuff is worth it, you can buy me a beer
beerware | beerware | short | (?:the )?beerware licen[cs]e
json | evil | text | the software shall be used for good, not evil
artistic | artistic | header | under the (?:terms of the )?(?:perl )?artistic license
artistic | perl | header | under the same terms as perl(?: itself)?
artistic-2.0 | artistic | title | (?:the )?artistic license 2\.0
artistic | package | text | the intent of this document is to state the conditions under which a package may be copied
python | python | text | this license agreement is between the python software foundation
python | psf | short | psfl?-2\.0
python | python | title | python software foundation license version 2
cnri | cnri | title | cnri open source license
postgresql | paragraphs | text | provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies
postgresql | obligations | text | has no obligations to provide maintenance, support, updates, enhancements, or modifications
curl | curl | title | curl licen[cs]e
openssl | openssl | text | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | ssleay | title | original ssleay licen[cs]e
php | php | text | this product includes php software, freely available from
php | php | title | php license(?:, version)? ?3\.0[01]?
ruby | ruby | header | under the same terms as ruby(?: itself)?
ruby | ruby | title | ruby licen[cs]e
w3c | w3c | title | w3c software (?:notice and )?(?:and document )?licen[cs]e
x11 | consortium | text | except as contained in this notice, the name of the x consortium shall not be used in advertising
xfree86 | xfree86 | title | xfree86 licen[cs]e
ncsa | illinois | title | university of illinois/ncsa open source license
ncsa | ncsa | short | ncsa licen[cs]e
afl | academic | title | academic free license(?: version)? ?\d?(?:\.\d)?
osl | osl | short | osl-?3\.0
osl | open | title | open software license(?: version)? ?3\.0
ofl | reserved | text | no modified version of the font software may use the reserved font name
ofl | font | header | this font software is licensed under the sil open font license
ofl | ofl | short | ofl-?1\.[01]
ms-pl | ms-pl | short | ms-pl
ms-rl | reciprocal | title | microsoft reciprocal license
ms-rl | ms-rl | short | ms-rl
cecill | cecill | short | cecill(?:-[abc])?(?: ?v?\d(?:\.\d)?)?
cecill | french | text | governed by the cecill(?:-[abc])? license under french law
mulan | mulan | title | mulan (?:permissive software|psl)(?: license)?(?:,? v(?:ersion)? ?2)?
upl | universal | title | universal permissive license(?: v ?1\.0)?
ecl | educational | title | educational community license(?:, version 2\.0)?
vim | vim | title | vim licen[cs]e
tcl | tcl | title | tcl/tk licen[cs]e
sleepycat | sleepycat | title | sleepycat licen[cs]e
qpl | q | title | q public license
npl | netscape | title | netscape public license
sspl | server | title | server side public license
sspl | sspl | short | sspl(?:-1\.0)?
elastic | elastic | title | elastic license(?: 2\.0)?
commons-clause | commons | title | "?commons clause"? license condition
commons-clause | rights | text | the grant of rights under the license will not include, and the license does not grant to you, the right to sell the software
polyform | polyform | title | polyform (?:noncommercial|shield|strict|small business|free trial|perimeter) license
openrail | openrail | short | (?:creativeml )?openrail(?:-?\+?\+?-?m)?
llama | llama | title | llama ?[23](?:\.[123])? community license
odbl | database | header | made available under the open database license
odc-by | attribution | title | open data commons attribution license
odc-by | odc-by | short | odc-by
pddl | pddl | short | pddl
ogl | government | title | open government licen[cs]e(?: v?\d(?:\.\d)?)?
cc-by | creative | header | licensed under (?:a |the )?creative commons attribution (?:[1-4]\.[05] )?(?:international |unported |generic )?licen[cs]e
cc-by | credit | text | you must give appropriate credit, provide a link to the license, and indicate if changes were made
cc-by-sa | remix | text | if you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original
cc-by-nc | commercial | text | you may not use the material for commercial purposes
cc-by-nd | remix | text | if you remix, transform, or build upon the material, you may not distribute the modified material
cc-by-sa | commons | title | creative commons attribution-share ?alike (?:[1-4]\.[05])
cc-by-nc | commons | title | creative commons attribution-non-?commercial (?:[1-4]\.[05])
cc-by-nd | noderivs | title | creative commons attribution-noderivs (?:[1-4]\.[05])
cc-by-nc-sa | commons | title | creative commons attribution-non-?commercial-share ?alike (?:[1-4]\.[05])
cc-by-nc-nd | commons | title | creative commons attribution-non-?commercial-noderiv(?:s|atives) (?:[1-4]\.[05])
cc-by-sa | cc-by-sa | short | cc-by-sa(?:[- ][1-4]\.[05])?
cc-by-nc | cc-by-nc | short | cc-by-nc(?:[- ][1-4]\.[05])?
cc0 | waived | text | to the extent possible under law, .{1,120}? has waived all copyright and related or neighboring rights
cc0 | affirmer | text | affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives
cc0 | universal | title | cc0 1\.0 universal
cc | reserved | short | some rights reserved
fdl | wikipedia | text | text of wikipedia is available under
public-domain | domain | text | (?:this work|this file|this code|the author|it) (?:is|has been placed|is placed|is released|has been released) (?:in|into|to) the public domain
public-domain | domain | text | no copyright is claimed, and this (?:work|file|software) is in the public domain
public-domain | government | text | works? of the (?:united states|u\.s\.) government
proprietary | confidential | text | (?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorized | text | unauthorized copying of this (?:file|software|document), via any medium,? is strictly prohibited
proprietary | eula | short | end[- ]user licen[cs]e agreement(?: \(eula\))?
proprietary | reproduced | text | no part of this (?:publication|document|book|work) may be reproduced
proprietary | consent | text | without the (?:express |prior )*written (?:consent|permission) of
proprietary | evaluation | text | for evaluation purposes only
proprietary | subscription | text | use of this software is governed by a subscription agreement
dual | dual | header | dual[- ]licensed under
dual | either | header | licensed under either of
dual | option | header | at your option, under either
"""


def signatures() -> list[tuple[str, str, str, str]]:
    """Label, keyword, kind and pattern of every signature."""
    return [tuple(x.strip() for x in line.split(" | ", 3)) for line in SIGNATURES.strip().splitlines()]
