"""License scans: ordered signature rules behind a keyword prefilter; of overlapping detections, one that lies
within another of at least its priority is suppressed."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD_BYTES, text_bytes

#: Phrases whose every place counts, whatever the rules say.
BASE = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    """pattern is matched on the text's words, one space between them; keyword is a word that every match has."""

    label: str
    keyword: str
    priority: int
    pattern: str


#: Families of licenses: label, a pattern of the name, a word that the name always has; a name whose forms share
#: no word has a line for each. Written by hand; each gives the rules of _family_rules.
FAMILIES = (
    ("apache", r"apache(?: software)? license", "apache"),
    ("mit", r"mit(?: x11)? license", "mit"),
    ("mit", r"expat license", "expat"),
    ("x11", r"x11 license", "x11"),
    ("bsd", r"bsd(?: (?:[0-4]|two|three|four) clause)?(?: (?:new|simplified|original|revised|style))? license", "bsd"),
    ("bsd", r"(?:[0-4]|two|three|four) clause bsd(?: license)?", "bsd"),
    ("isc", r"isc license", "isc"),
    ("zlib", r"zlib(?: libpng)? license", "zlib"),
    ("libpng", r"libpng license", "libpng"),
    ("boost", r"boost software license", "boost"),
    ("mpl", r"mozilla public license", "mozilla"),
    ("gpl", r"gnu (?:general public license|gpl)", "gnu"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license", "public"),
    ("agpl", r"(?:gnu )?affero general public license", "affero"),
    ("fdl", r"(?:gnu )?free documentation license", "documentation"),
    ("epl", r"eclipse public license", "eclipse"),
    ("edl", r"eclipse distribution license", "eclipse"),
    ("cddl", r"common development and distribution license", "distribution"),
    ("cpl", r"common public license", "common"),
    ("ipl", r"ibm public license", "ibm"),
    ("eupl", r"european union public licen[cs]e", "european"),
    ("osl", r"open software license", "open"),
    ("afl", r"academic free license", "academic"),
    ("artistic", r"(?:perl )?artistic license", "artistic"),
    ("perl", r"same terms as perl(?: itself)?", "perl"),
    ("python", r"python(?: software foundation)? license", "python"),
    ("ruby", r"ruby license", "ruby"),
    ("php", r"php license", "php"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("openssl", r"openssl license", "openssl"),
    ("ofl", r"(?:sil )?open font license", "font"),
    ("unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"wtfpl", "wtfpl"),
    ("wtfpl", r"do what the fuck you want to public license", "public"),
    ("cc0", r"cc0", "cc0"),
    ("cc0", r"(?:creative commons zero|cc zero)", "zero"),
    ("cc-by", r"creative commons attribution(?: \d)?", "attribution"),
    ("cc-by-sa", r"creative commons attribution share ?alike", "attribution"),
    ("cc-by-nc", r"creative commons attribution non ?commercial", "attribution"),
    ("cc-by-nd", r"creative commons attribution no ?derivatives?", "attribution"),
    ("odbl", r"open (?:data commons open )?database license", "database"),
    ("pddl", r"public domain dedication and license", "dedication"),
    ("odc-by", r"open data commons attribution license", "attribution"),
    ("ms-pl", r"microsoft public license", "microsoft"),
    ("ms-rl", r"microsoft reciprocal license", "microsoft"),
    ("ncsa", r"(?:university of illinois )?ncsa open source license", "ncsa"),
    ("upl", r"universal permissive license", "universal"),
    ("blueoak", r"blue oak model license", "oak"),
    ("bsl", r"business source license", "business"),
    ("sspl", r"server side public license", "server"),
    ("elastic", r"elastic license", "elastic"),
    ("commons-clause", r"commons clause", "commons"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict)(?: license)?", "polyform"),
    ("mulan", r"mulan (?:permissive|psl|publ)\w*(?: software)?(?: license)?", "mulan"),
    ("cecill", r"cecill(?: [abc])?(?: license)?", "cecill"),
    ("ecl", r"educational community license", "educational"),
    ("w3c", r"w3c software(?: notice and)? license", "w3c"),
    ("vim", r"vim license", "vim"),
    ("openrail", r"openrail(?: m| s)?(?: license)?", "openrail"),
    ("openrail", r"open rail(?: m| s)?(?: license)?", "rail"),
    ("llama", r"llama(?: \d)? community license", "llama"),
    ("gemma", r"gemma terms of use", "gemma"),
    ("json", r"json license", "json"),
    ("beerware", r"beerware license", "beerware"),
    ("beerware", r"beer ware license", "ware"),
    ("intel", r"intel open source license", "intel"),
    ("sun", r"sun public license", "sun"),
    ("sleepycat", r"sleepycat license", "sleepycat"),
    ("qpl", r"q public license", "public"),
    ("zpl", r"zope public license", "zope"),
)

#: Short identifiers as they stand after a tag, in words, with their label.
IDENTIFIERS = (
    ("apache", r"apache 2 0"), ("mit", "mit"), ("bsd", r"bsd [0-4] clause"), ("bsd", "0bsd"), ("isc", "isc"), ("zlib", "zlib"), ("boost", r"bsl 1 0"),
    ("mpl", r"mpl [12] \d"), ("gpl", r"gpl [123] 0"), ("lgpl", r"lgpl [23] [01]"), ("agpl", r"agpl [13] 0"), ("fdl", r"gfdl 1 [123]"), ("epl", r"epl [12] 0"),
    ("cddl", r"cddl 1 [01]"), ("eupl", r"eupl 1 [0-2]"), ("artistic", r"artistic [12] 0"), ("python", r"python 2 0|psf 2 0"), ("ofl", r"ofl 1 [01]"),
    ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("cc0", r"cc0 1 0"), ("cc-by", r"cc by [1-4] [05]"), ("cc-by-sa", r"cc by sa [1-4] [05]"),
    ("cc-by-nc", r"cc by nc(?: (?:sa|nd))? [1-4] [05]"), ("cc-by-nd", r"cc by nd [1-4] [05]"), ("odbl", r"odbl 1 0"), ("ms-pl", "ms pl"), ("ncsa", "ncsa"), ("upl", r"upl 1 0"),
)

#: Sentences of license texts and notices, matched as they stand.
TEXTS = (
    ("mit", "permission", 70, r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "sublicense", 65, r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc", "permission", 70, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", 70, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", 60, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", 60, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "endorse", 60, r"names of its contributors may be used to endorse or promote products"),
    ("apache", "compliance", 70, r"you may not use this file except in compliance with the license"),
    ("gpl", "redistribute", 70, r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", 72, r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute", 72, r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl", "mozilla", 70, r"this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "altered", 65, r"altered source versions must be plainly marked as such"),
    ("boost", "boost", 70, r"distributed under the boost software license"),
    ("unlicense", "unencumbered", 70, r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", 55, r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("public-domain", "domain", 50, r"public domain"),
    ("no-warranty", "warranty", 45, r"without warranty of any kind(?: express or implied)?"),
    ("no-warranty", "merchantability", 45, r"(?:implied warranty|warranties) of merchantability"),
    ("as-is", "provided", 40, r"(?:software|work) is provided as is"),
    ("proprietary", "confidential", 60, r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", 60, r"unauthorized (?:copying|reproduction|distribution|use) (?:of this \w+ )?(?:via any medium )?is (?:strictly )?prohibited"),
    ("proprietary", "permission", 60, r"(?:may not be|no part of this \w+ may be) (?:reproduced|copied|distributed)[a-z ]{0,80} without (?:the )?(?:prior )?(?:express )?(?:written )?permission"),
    ("reserved", "reserved", 50, r"(?:all|some) rights reserved"),
    ("copyright", "copyright", 30, r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*"),
    ("copyright", "copyright", 30, r"copyright by"),
    ("cc-by", "attribution", 40, r"attribution(?: [1-4] [05])? international"),
    ("non-commercial", "commercial", 45, r"(?:for )?non commercial use only"),
    ("non-commercial", "noncommercial", 45, r"(?:for )?noncommercial use only"),
    ("non-commercial", "personal", 45, r"(?:for )?personal use only"),
    ("trademark", "trademark", 30, r"(?:registered )?trademark of"),
    ("trademark", "trademarks", 30, r"(?:registered )?trademarks of"),
    ("gpl", "gpl", 40, r"(?:under the )?gpl(?: v?[123])?(?: (?:or later|only))?"),
    *(("gpl", f"gpl{v}", 40, rf"(?:under the )?gpl{v}(?: (?:or later|only))?") for v in ("1", "2", "3", "v1", "v2", "v3")),
    ("lgpl", "lgpl", 42, r"(?:under the )?lgpl(?: v?[23])?(?: [01])?"),
    *(("lgpl", f"lgpl{v}", 42, rf"(?:under the )?lgpl{v}(?: [01])?") for v in ("2", "3", "v2", "v3")),
    ("agpl", "agpl", 42, r"(?:under the )?agpl(?: v?3)?"),
    *(("agpl", f"agpl{v}", 42, rf"(?:under the )?agpl{v}") for v in ("3", "v3")),
)

#: More sentences of license texts, deeds, notices and terms: label, keyword, priority and pattern. Written by hand.
NOTICES = r"""
mit substantial 75 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit restriction 60 without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit copyright 55 in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit connection 55 arising from out of or in connection with the software or the use or other dealings in the software
mit-0 permission 70 permission is hereby granted (?:\w+ ){0,30}to permit persons to whom the software is furnished to do so the software is provided
x11 advertising 70 except as contained in this notice the name of (?:the )?(?:\w+ ){1,6}shall not be used in advertising
isc permission 65 provided that the above copyright notice and this permission notice appear in all copies
isc warranties 60 the software is provided as is and the author disclaims all warranties with regard to this software
isc consequential 55 in no event shall the author be liable for any special direct indirect or consequential damages
0bsd distribute 70 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
bsd documentation 65 this list of conditions and the following disclaimer in the documentation and or other materials
bsd contributors 62 neither the name of (?:the )?(?:\w+ ){1,8}nor the names of its contributors may be used
bsd redistributions 60 redistributions of source code must retain (?:the above|this) (?:copyright notice|list)
bsd copyright 55 in no event shall the copyright (?:holder|owner)s?(?: or contributors)? be liable
bsd contributors 55 this software is provided by the (?:copyright holders|author|regents) and contributors as is
bsd-4 advertising 72 all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd conditions 50 provided that the following conditions are met
bsd interruption 55 substitute goods or services loss of use data or profits or business interruption
zlib provided 70 this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib applications 65 permission is granted to anyone to use this software for any purpose including commercial applications
zlib misrepresented 65 the origin of this software must not be misrepresented
zlib distribution 60 this notice may not be removed or altered from any source distribution
libpng distribution 65 this copyright notice may not be removed or altered from any source or altered source distribution
boost documentation 68 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost executable 60 machine executable object code generated by a source language processor
apache distributed 72 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache conditions 65 without warranties or conditions of any kind either express or implied see the license for the specific language
apache limitations 62 see the license for the specific language governing permissions and limitations under the license
apache licenses 60 you may obtain a copy of the license at http www apache org licenses
apache developed 58 this product includes software developed (?:by|at) the apache (?:software foundation|group)
apache contributor 60 contributor license agreements see the notice file distributed with this work
apache irrevocable 60 perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
apache alv2 50 alv2
gpl license 68 either version [123] of the license or (?:at your option )?any later version
gpl received 65 you should have received a copy of the gnu general public license along with
gpl distributed 62 this program is distributed in the hope that it will be useful but without any warranty
gpl details 60 see the gnu general public license for more details
gpl foundation 58 free software foundation inc (?:51 franklin|59 temple|675 mass)
gpl redistribute 55 this program is free software you can redistribute it
gpl redistribute 58 this is free software and you are welcome to redistribute it under certain conditions
gpl distribute 55 everyone is permitted to copy and distribute verbatim copies of this license document
gpl distributed 60 distributed under the terms of the gnu gpl
gpl exception 55 linking exception
gpl independent 52 link(?:ed|ing)? (?:with )?independent modules
gpl classpath 55 gnu classpath exception
gpl foundation 50 as published by the free software foundation
gpl copyleft 45 copyleft
lgpl received 66 you should have received a copy of the gnu (?:lesser|library) general public license along with
lgpl details 60 see the gnu (?:lesser|library) general public license for more details
lgpl redistribute 58 this library is free software you can redistribute it
lgpl software 55 this license applies to any software library or other program
agpl received 66 you should have received a copy of the gnu affero general public license along with
agpl interaction 60 remote network interaction
agpl interacting 58 users interacting with it remotely through a computer network
fdl documentation 65 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
fdl invariant 58 with no invariant sections no front cover texts and no back cover texts
fdl gfdl 45 gfdl
mpl distributed 65 if a copy of the mpl was not distributed with this file you can obtain one at
mpl contents 62 the contents of this file are subject to the mozilla public license
mpl incompatible 60 incompatible with secondary licenses
mpl mpl 45 mpl [12] [01]
npl netscape 60 netscape public license
epl accompanying 65 this program and the accompanying materials are made available under the terms of the eclipse public license
epl distribution 58 any use reproduction or distribution of the program constitutes recipient s acceptance
epl epl 45 epl [12] 0
cddl distribution 62 the contents of this file are subject to the terms of the common development and distribution license
cddl cddl 45 cddl
cpl cpl 50 cpl 1 0
eupl licensed 60 licensed under the eupl
eupl eupl 50 eupl v?(?: ?1 ?[012])?
ms-pl software 60 if you use the software you accept this license if you do not accept the license do not use the software
artistic conditions 60 the intent of this document is to state the conditions under which a package may be copied
artistic copyright 55 the copyright holder maintains some semblance of artistic control
perl redistribute 58 this (?:library|module|program) is free software you can redistribute it and or modify it under the same terms as perl
python agreement 60 psf license agreement
python available 58 psf is making python available to licensee on an as is basis
python agreement 55 cnri open source license agreement
ruby modifying 55 you may make your own ways of modifying the software
php available 60 this product includes php software freely available from
postgresql consequential 60 in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
openssl developed 62 this product includes software developed by the openssl project for use in the openssl toolkit
openssl cryptographic 60 this product includes cryptographic software written by eric young
ofl reserved 62 reserved font name
ofl modified 60 the font software may be modified altered or added to
ofl license 55 the goals of the open font license
unlicense distribute 66 anyone is free to copy modify publish use compile sell or distribute this software
unlicense jurisdictions 60 in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
wtfpl fuck 66 you just do what the fuck you want to
beerware stuff 66 if we meet some day and you think this stuff is worth it you can buy me a beer
json software 66 the software shall be used for good not evil
cc0 associated 66 the person who associated a work with this deed has dedicated the work to the public domain
cc0 copyright 62 to the extent possible under law (?:\w+ ){1,8}(?:has|have) waived all copyright and related
cc0 copyright 55 no copyright reserved
cc0 cc0 45 cc0 1 0
cc-by attribution 66 this work is licensed under a creative commons attribution(?: [1-4] [05])? (?:international |unported |generic )?license
cc-by appropriate 60 you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by creativecommons 58 creativecommons org licenses by [1-4] [05]
cc-by licensed 40 licensed under cc by(?: [1-4] [05])?
cc-by-sa contributions 62 if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-sa creativecommons 60 creativecommons org licenses by sa
cc-by-sa attribution 56 text is available under the creative commons attribution share ?alike
cc-by-sa by 42 cc by sa
cc-by-nc commercial 62 you may not use the material for commercial purposes
cc-by-nc creativecommons 60 creativecommons org licenses by nc
cc-by-nc by 42 cc by nc
cc-by-nd distribute 62 if you remix transform or build upon the material you may not distribute the modified material
cc-by-nd creativecommons 60 creativecommons org licenses by nd
cc-by-nd by 42 cc by nd
cc-pdm creativecommons 60 creativecommons org publicdomain mark
cc0 creativecommons 60 creativecommons org publicdomain zero
cc creative 30 creative commons licen[cs]e
cc reserved 30 some rights reserved
odbl opendatacommons 60 opendatacommons org licenses odbl
odbl available 55 made available under the open database license
pddl opendatacommons 60 opendatacommons org licenses pddl
odc-by opendatacommons 60 opendatacommons org licenses by
ogl government 60 open government licen[cs]e
ogl information 58 contains public sector information licensed under
ogl copyright 50 crown copyright
etalab licence 60 licence ouverte
dl-de datenlizenz 60 datenlizenz deutschland
cdla agreement 60 community data license agreement
os initiative 45 open source initiative
open-access distributed 50 this is an open access article distributed under the terms
open-access access 45 open access
public-domain domain 58 this work is in the public domain
public-domain government 58 works? of the (?:us|u s|united states) (?:federal )?government (?:is|are) (?:not subject to copyright|in the public domain)
public-domain protection 56 not subject to copyright protection in the united states
public-domain copyright 55 (?:its|the) copyright (?:term )?has expired
public-domain restrictions 55 no known copyright restrictions
public-domain dedicated 52 dedicated to the public domain
bsl additional 62 additional use grant
bsl change 58 change date
sspl functionality 62 making the functionality of the program or modified version available to third parties as a service
elastic software 62 you may not provide the software to third parties as a hosted or managed service
commons-clause software 64 the license does not grant to you the right to sell the software
polyform noncommercial 60 any noncommercial purpose is a permitted purpose
openrail restrictions 60 use based restrictions
openrail responsible 55 responsible ai licen[cs]e
llama built 60 built with (?:meta )?llama
llama materials 58 llama materials
gemma prohibited 55 gemma prohibited use policy
model-license derivatives 50 model derivatives
proprietary confidential 66 this (?:document|file|software|code) contains (?:proprietary and )?confidential information
proprietary information 62 trade secrets?(?: and confidential)? information of
proprietary internal 62 for internal use only
proprietary permission 60 do not (?:copy|distribute|disclose|redistribute) without (?:prior )?(?:written )?permission
proprietary without 60 may not be (?:copied|reproduced|modified|published|transmitted|distributed|displayed|sold|used) (?:in any form |in whole or in part )?without (?:the )?(?:prior |express |written )*(?:permission|consent)
proprietary confidential 58 strictly confidential
proprietary agreement 58 all use is subject to the terms of the (?:license|end user) agreement
proprietary agreement 58 end user licen[cs]e agreement
proprietary may 56 you may not (?:reverse engineer|decompile|disassemble)
proprietary licensed 55 this software is licensed not sold
proprietary software 55 by (?:installing|downloading|using) (?:this|the) software you agree
proprietary eula 52 eula
proprietary conditions 50 subject to the terms and conditions of (?:your|the) agreement with
proprietary unpublished 50 unpublished work
proprietary restricted 50 restricted rights(?: legend)?
proprietary restrictions 50 use duplication or disclosure by the (?:us |u s )?government is subject to restrictions
no-redistribution redistribution 55 redistribution is (?:not permitted|prohibited|forbidden)
no-redistribution for 52 not for (?:redistribution|resale|publication)
no-derivatives derivative 48 no derivative works
non-commercial only 55 for non ?commercial (?:purposes|use|research) only
non-commercial commercial 55 may not be used for commercial purposes
non-commercial commercial 52 commercial use (?:is )?(?:prohibited|forbidden|not permitted|not allowed)
non-commercial free 50 free for (?:personal|private|non commercial|noncommercial|academic|educational) use
non-commercial only 50 for (?:academic|educational|research|evaluation) (?:use|purposes) only
share-alike under 45 under the same (?:or (?:a )?similar )?licen[cs]e
permissive distribute 45 free to use copy modify and distribute
permissive free 45 you are free to (?:share|copy|use|adapt|remix)
permissive royalty 42 royalty free
permissive charge 42 free of charge
permissive software 40 open source software
permissive software 40 free software
attribution credit 48 credit (?:must be|is) given to
attribution please 46 please (?:credit|cite|attribute)
attribution attribution 46 with (?:proper|appropriate|due) attribution
attribution credited 45 provided (?:that )?the (?:original )?(?:author|source)s? (?:is|are) credited
attribution permission 45 reprinted (?:with|by) permission
attribution permission 44 used (?:with|by) (?:kind )?permission
attribution permission 44 reproduced (?:with|by) (?:the )?(?:kind )?permission
copyright reproduced 48 no part of this (?:publication|book|work|document|website|site) may be reproduced
copyright transmitted 46 stored in a retrieval system or transmitted in any form or by any means
copyright copyright 46 protected by (?:international |us |u s )?copyright (?:law|laws|and)
copyright infringement 45 copyright infringement
copyright copyrighted 44 copyrighted (?:material|work|content)
copyright copyrighted 42 is copyrighted by
copyright copyright 42 copyright (?:holder|owner)s?
copyright copyright 40 (?:the )?copyright (?:is|remains) (?:held|owned|with)
copyright copyright 38 copyright notice
copyright reserves 36 tous droits reserves
copyright réservés 36 tous droits réservés
copyright vorbehalten 36 alle rechte vorbehalten
copyright reservados 36 todos los derechos reservados
copyright riservati 36 tutti i diritti riservati
copyright reservados 36 todos os direitos reservados
copyright urheberrechtlich 34 urheberrechtlich geschützt
copyright auteur 34 droit d auteur
copyright derechos 34 derechos de autor
copyright copr 30 copr
fair-use fair 46 fair (?:use|dealing)
fair-use copyright 44 section 107 of the copyright act
dmca millennium 50 digital millennium copyright act
dmca dmca 46 dmca (?:notice|takedown|policy|agent)
terms apply 40 terms (?:of (?:use|service)|and conditions) apply
terms subject 40 subject to (?:the|our|these) terms of (?:use|service)
terms terms 38 terms of (?:use|service)
patent patent 48 patent (?:pending|rights|license|licence|grant)
patent protected 44 protected by (?:one or more )?(?:us |u s )?patents?
trademark of 42 (?:are|is) (?:a )?(?:registered )?trade ?marks? (?:or registered trade ?marks? )?of
trademark respective 40 all (?:other )?trade ?marks are (?:the )?property of their respective owners
trademark registered 36 registered in the (?:us|u s) patent and trade ?mark office
trademark service 34 service marks? of
no-warranty warranties 50 disclaims? all (?:other )?(?:implied )?warranties
no-warranty provided 50 provided without (?:any )?(?:express or implied )?warranty
no-warranty no 48 makes? no (?:representations?|warrant(?:y|ies)) (?:about|of any kind|as to|regarding)
no-warranty particular 48 fitness for a particular purpose
no-warranty noninfringement 48 noninfringement
no-warranty infringement 48 non infringement
no-warranty risk 46 at your own risk
no-warranty liable 46 shall not be (?:held )?liable for any
no-warranty limitation 45 limitation of liability
no-warranty risk 44 use of this (?:software|site|information) is at your own risk
as-is where 42 as is where is
as-is basis 42 on an as is basis
dual dual 50 dual licen[cs]ed
dual available 48 available under (?:either|both) (?:the )?(?:\w+ ){1,5}(?:or|and) (?:the )?(?:\w+ ){1,5}licen[cs]e
file see 46 see (?:the )?(?:accompanying )?licen[cs]e (?:file|txt|md)
file license 46 license txt
file copying 44 copying file
file licensed 44 licensed under the terms (?:found|described|specified) in
spdx identifier 60 spdx license identifier \w+
spdx filecopyrighttext 50 spdx filecopyrighttext
"""


def _family_rules(label: str, name: str, keyword: str) -> list[Rule]:
    """The rules of a family, most telling first: a grant under it, one with a version, its text's title, its name."""
    version = r"(?:,? (?:version|v) ?\d+(?: \d+)*| v?\d+(?: \d+)*)"
    grant = r"(?:licensed|released|distributed|available|published|covered|redistributed|provided)(?: \w+)? (?:under|by)(?: the)?(?: terms of(?: the)?)?"
    return [
        Rule(label, keyword, 90, f"{grant} {name}{version}(?: or (?:any )?later(?: version)?)?"),
        Rule(label, keyword, 80, f"{grant} {name}"),
        Rule(label, keyword, 60, f"{name}{version}(?: or (?:any )?later(?: version)?)?"),
        Rule(label, keyword, 50, name),
    ]


def rules() -> list[Rule]:
    """All rules in order of priority, then as listed."""
    made = [rule for family in FAMILIES for rule in _family_rules(*family)]
    made += [Rule(label, "spdx", 95, rf"spdx license identifier (?:{name})(?: only| or later)?") for label, name in IDENTIFIERS]
    made += [Rule(label, "license", 75, rf"license (?:is |id |type )?(?:{name})") for label, name in IDENTIFIERS]
    made += [Rule(label, keyword, priority, pattern) for label, keyword, priority, pattern in TEXTS]
    notices = [line.split(" ", 3) for line in NOTICES.strip().splitlines()]
    made += [Rule(label, keyword, int(priority), pattern) for label, keyword, priority, pattern in notices]
    return sorted(made, key=lambda r: -r.priority)


class Scanner:
    """The rules, compiled, by the keyword that a text must have for them to be tried."""

    def __init__(self, table: list[Rule] | None = None):
        self.rules = rules() if table is None else sorted(table, key=lambda r: -r.priority)
        self.patterns = [re.compile(rb"(?<= )(?:" + r.pattern.encode() + rb")(?= )") for r in self.rules]
        self.by_keyword: dict[bytes, list[int]] = {}
        for k, rule in enumerate(self.rules):
            self.by_keyword.setdefault(rule.keyword.encode(), []).append(k)
        self.keywords = frozenset(self.by_keyword)

    def detections(self, found: list[bytes], joined: bytes) -> list[tuple[int, int, int]]:
        """(first word, end word, rule) of what stands after suppression; joined: the words, a space around each.

        Detections are taken in order of priority, then length, then place. One that lies within a taken one
        is suppressed."""
        tried = sorted(k for word in self.keywords.intersection(found) for k in self.by_keyword[word])
        hits = [(-self.rules[k].priority, m.start() - m.end(), m.start(), m.end(), k) for k in tried for m in self.patterns[k].finditer(joined)]
        hits.sort(key=lambda h: h[2])
        kept: list[tuple[int, int, int]] = []
        cluster, end = [], 0  # detections that overlap, one with the next
        for hit in [*hits, (0, 0, len(joined) + 1, 0, 0)]:
            if cluster and hit[2] >= end:
                own: list[tuple[int, int, int]] = []
                for _, _, a, b, k in sorted(cluster):
                    if not any(a0 <= a and b <= b0 for a0, b0, _ in own):
                        own.append((a, b, k))
                kept += own
                cluster = []
            cluster.append(hit)
            end = max(end, hit[3]) if len(cluster) > 1 else hit[3]
        out, at, word = [], 0, 0
        for a, b, k in sorted(kept):
            word += joined.count(b" ", at, a)
            at = a
            out.append((word - 1, word + joined.count(b" ", a, b), k))
        return out


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    out = []
    for phrase, label in BASE:
        needle, word, seen = b" " + phrase + b" ", -1, 0
        at = joined.find(needle)
        while at >= 0:
            word += joined.count(b" ", seen, at + 1)
            seen = at + 1
            out.append((word, label))
            at = joined.find(needle, seen)
    return out


def scan(text: bytes, scanner: Scanner) -> dict:
    """The counts, labels and detections of one whole text."""
    found = text.lower().translate(WORD_BYTES).split()
    joined = b" ".join((b"", *found, b"")) if found else b" "
    base = base_places(joined)
    hits = scanner.detections(found, joined)
    base_labels = {label for _, label in base}
    labels = base_labels | {scanner.rules[k].label for _, _, k in hits}
    strength = max([0.5 * bool(base), *(scanner.rules[k].priority / 100 for _, _, k in hits)])
    covered = sum(b - a for a, b, _ in hits)
    return {
        "n_words": len(found), "n_base": len(base), "first_word": min((p for p, _ in base), default=None), "last_word": max((p for p, _ in base), default=None),
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)),
        "score": min(1.0, strength + (1 - strength) * min(1.0, covered / len(found))) if found else 0.0,
        "detections": [{"label": scanner.rules[k].label, "priority": scanner.rules[k].priority, "first_word": a, "end_word": b} for a, b, k in hits],
    }


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<label: string, priority: int, first_word: long, end_word: long>>"
)


def license_scan(docs: DataFrame, table: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """SCHEMA: for each row of docs(doc_id, text), the places of the base phrases in the whole text, the labels
    of base and rules, the rules' detections that stand, and a score of how sure a license is from 0 (none) to 1.

    Null and empty texts have no words and a score of 0; null doc_ids and repeated rows are scanned each; extra
    columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        scanner, kinds = Scanner(table), None
        for batch in batches:
            rows = [scan(t, scanner) for t in batch.column(1).to_pylist()]
            kinds = kinds or {
                **dict.fromkeys(("n_words", "n_base", "first_word", "last_word"), pa.int64()), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
                "detections": pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64())])),
            }
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in rows], t) for c, t in kinds.items())], names=["doc_id", *kinds])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return source.mapInArrow(run, SCHEMA)
