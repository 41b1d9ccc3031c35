"""Signatures of license notices and texts, written out by hand.

(label, regex over lower-case words joined by single blanks, keywords that every match holds). All are sentences of published
licenses or of the notices that these ask for.
"""

NOTICES = [
    # Apache
    ("apache-2.0", r"\blicensed under the apache license version 2 0 the license\b", "apache license"),
    ("apache-2.0", r"\byou may not use this (?:file|work|software) except in compliance with the license\b", "except compliance"),
    ("apache-2.0", r"\bunless required by applicable law or agreed to in writing\b", "applicable writing"),
    ("apache-2.0", r"\blicensed to the apache software foundation (?:asf )?under one or more contributor license agreements\b", "apache contributor"),
    ("apache-2.0", r"\bapache org licenses license 2 0\b", "apache licenses"),
    ("apache-1.1", r"\bthis product includes software developed by the apache (?:software foundation|group)\b", "product apache"),
    ("apache", r"\bthe names apache (?:server )?and apache (?:software foundation|group) must not be used\b", "apache must"),
    # GNU
    ("gpl-2-or-later", r"\bredistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2\b", "redistribute foundation"),
    ("gpl-3-or-later", r"\bredistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3\b", "redistribute foundation"),
    ("gpl-2-only", r"\bunder the terms of version 2 of the gnu general public license as published\b", "general published"),
    ("gpl-3-only", r"\bunder the terms of version 3 of the gnu general public license as published\b", "general published"),
    ("gpl", r"\byou should have received a copy of the gnu general public license along with\b", "received general"),
    ("lgpl", r"\byou should have received a copy of the gnu (?:lesser|library) general public license along with\b", "received general"),
    ("agpl", r"\byou should have received a copy of the gnu affero general public license along with\b", "received affero"),
    ("gpl", r"\bwithout even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details\b", "merchantability general"),
    ("gpl-with-classpath-exception", r"\blinking this library statically or dynamically with other modules is making a combined work\b", "statically combined"),
    ("gpl-with-font-exception", r"\bif you create a document which uses this font and embed this font\b", "document embed"),
    ("gpl-with-gcc-exception", r"\bgcc runtime library exception\b", "runtime exception"),
    ("gpl-with-linking-exception", r"\bspecial exception the copyright holders give you permission to link\b", "exception permission"),
    ("gpl-with-autoconf-exception", r"\bconfiguration script generated by autoconf\b", "configuration autoconf"),
    ("gfdl", r"\bpermission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license\b", "documentation granted"),
    ("gfdl", r"\bgnu free documentation license\b", "documentation license"),
    ("gfdl-no-invariants", r"\bwith no invariant sections no front cover texts and no back cover texts\b", "invariant sections"),
    # MIT family
    ("mit", r"\bto deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell\b", "restriction sublicense"),
    ("mit", r"\bthe above copyright notice and this permission notice shall be included in all copies or substantial portions of the software\b", "substantial portions"),
    ("mit", r"\bin no event shall the authors or copyright holders be liable for any claim damages or other liability\b", "holders liable"),
    ("mit", r"\bopensource org licenses mit\b", "opensource licenses"),
    ("mit", r"\b(?:released|distributed|available) under (?:the )?(?:terms of the )?mit license\b", "under license"),
    ("mit-0", r"\bmit no attribution\b", "attribution mit"),
    ("x11", r"\bexcept as contained in this notice the names? of the x consortium shall not be used in advertising\b", "consortium advertising"),
    ("x11-distribute-modifications", r"\bto use copy modify merge publish distribute distribute with modifications sublicense\b", "modifications sublicense"),
    ("icu", r"\bexcept as contained in this notice the name of a copyright holder shall not be used in advertising\b", "contained advertising"),
    ("hpnd", r"\bpermission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted\b", "documentation hereby"),
    ("hpnd", r"\bnot be used in advertising or publicity pertaining to distribution of the software without specific written prior permission\b", "publicity pertaining"),
    ("isc", r"\bpermission to use copy modify and distribute this software for any purpose with or without fee is hereby granted\b", "purpose hereby"),
    ("0bsd", r"\bfor any purpose with or without fee is hereby granted the software is provided as is\b", "purpose provided"),
    ("ntp", r"\bthe university of delaware makes no representations about the suitability\b", "delaware suitability"),
    ("curl", r"\bcopyright (?:c )?(?:\d{4} )*daniel stenberg\b", "daniel stenberg"),
    ("boost-1.0", r"\bpermission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation\b", "organization accompanying"),
    ("boost-1.0", r"\bdistributed under the boost software license\b", "boost license"),
    ("ncsa", r"\buniversity of illinois ncsa open source license\b", "illinois ncsa"),
    ("ncsa", r"\bneither the names of [a-z0-9 ]{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software\b", "contributors endorse"),
    ("unicode", r"\bdata files or software provided that [a-z0-9 ]{0,80}?copyright and permission notice appear with all copies\b", "provided copies"),
    ("unicode", r"\bunicode inc license agreement data files and software\b", "unicode agreement"),
    # BSD family
    ("bsd-2-clause", r"\bredistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form\b", "redistributions retain"),
    ("bsd-3-clause", r"\bmay be used to endorse or promote products derived from this software without specific prior written permission\b", "endorse derived"),
    ("bsd-4-clause", r"\ball advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment\b", "advertising mentioning"),
    ("bsd-3-clause-clear", r"\bno express or implied licenses to any party s patent rights are granted by this license\b", "express patent"),
    ("bsd-3-clause-no-nuclear", r"\bnot designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility\b", "designed nuclear"),
    ("bsd-2-clause-patent", r"\bsubject to the terms and conditions of this license each copyright holder and contributor hereby grants\b", "holder grants"),
    ("bsd", r"\bin no event shall the (?:regents|copyright holders?|author)(?: or contributors)? be liable for any direct indirect incidental special exemplary or consequential damages\b", "exemplary consequential"),
    ("bsd", r"\bgoverned by a bsd style license(?: that can be found in the license file)?\b", "governed bsd"),
    ("bsd-source-code", r"\bredistributions of source code must retain the above copyright notice\b", "redistributions retain"),
    ("postgresql", r"\bpermission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted\b", "documentation agreement"),
    ("openssl", r"\bthis product includes software developed by the openssl project\b", "product openssl"),
    ("ssleay", r"\bthis product includes cryptographic software written by eric young\b", "cryptographic eric"),
    ("php-3.01", r"\bthis product includes php software freely available from\b", "freely php"),
    ("zend", r"\bthis product includes the zend engine\b", "product zend"),
    ("xfree86", r"\bthis product includes software developed by the xfree86 project\b", "product xfree86"),
    # Weak copyleft
    ("mpl-1.1", r"\bthe contents of this file are subject to the mozilla public license version 1 1\b", "contents mozilla"),
    ("mpl-2.0", r"\bthis source code form is subject to the terms of the mozilla public license v 2 0\b", "source mozilla"),
    ("mpl-2.0", r"\bif a copy of the mpl was not distributed with this file\b", "mpl distributed"),
    ("mpl-2.0", r"\bincompatible with secondary licenses as defined by the mozilla public license\b", "incompatible mozilla"),
    ("npl-1.1", r"\bnetscape public license version 1 1\b", "netscape public"),
    ("cddl-1.0", r"\bthe contents of this file are subject to the terms of the common development and distribution license\b", "contents development"),
    ("epl-1.0", r"\bthis program and the accompanying materials are made available under the terms of the eclipse public license v1 0\b", "accompanying eclipse"),
    ("epl-2.0", r"\bthis program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0\b", "accompanying eclipse"),
    ("edl-1.0", r"\beclipse distribution license\b", "eclipse distribution"),
    ("cpl-1.0", r"\bthe accompanying program is provided under the terms of this common public license\b", "accompanying common"),
    ("ipl-1.0", r"\bthe accompanying program is provided under the terms of this ibm public license\b", "accompanying ibm"),
    ("eupl-1.2", r"\blicensed under the eupl version 1 2\b", "licensed eupl"),
    ("eupl-1.1", r"\blicensed under the eupl version 1 1\b", "licensed eupl"),
    ("apsl-2.0", r"\bthis file contains original code and or modifications of original code as defined in and that are subject to the apple public source license version 2 0\b", "original apple"),
    ("sleepycat", r"\bredistributions in any form must be accompanied by information on how to obtain complete source code\b", "redistributions obtain"),
    ("artistic-1.0", r"\bthe intent of this document is to state the conditions under which a package may be copied\b", "intent package"),
    ("artistic-2.0", r"\bthis license establishes the terms under which a given free software package may be copied modified distributed\b", "establishes package"),
    ("perl", r"\bsame terms as (?:the )?perl(?: 5)?(?: programming language system)?(?: itself)?\b", "same perl"),
    ("ruby", r"\bdistributed under the same terms as ruby\b", "distributed ruby"),
    ("vim", r"\bvim is charityware\b", "charityware vim"),
    ("lppl-1.3", r"\bthis work may be distributed and or modified under the conditions of the latex project public license\b", "conditions latex"),
    ("cecill-2.1", r"\bthis software is governed by the cecill license under french law\b", "governed cecill"),
    ("qpl-1.0", r"\bq public license version 1 0\b", "public version"),
    ("wxwindows", r"\bwxwindows library licen[cs]e\b", "wxwindows library"),
    ("osl-3.0", r"\blicensed under the open software license version 3 0\b", "licensed open"),
    ("afl-3.0", r"\blicensed under the academic free license version 3 0\b", "licensed academic"),
    ("reciprocal", r"\breciprocal public license\b", "reciprocal public"),
    ("ms-pl", r"\bthis license governs use of the accompanying software if you use the software you accept this license\b", "governs accompanying"),
    # Public domain and dedications
    ("unlicense", r"\banyone is free to copy modify publish use compile sell or distribute this software\b", "anyone compile"),
    ("unlicense", r"\bin jurisdictions that recognize copyright laws the author or authors of this software dedicate\b", "jurisdictions dedicate"),
    ("cc0", r"\bto the extent possible under law the (?:author|person|copyright holder)[a-z0-9 ]{0,60}?waived all copyright\b", "extent waived"),
    ("cc0", r"\bno copyright universal public domain dedication\b", "universal dedication"),
    ("cc-pdm", r"\bpublic domain mark 1 0\b", "domain mark"),
    ("wtfpl", r"\beveryone is permitted to copy and distribute verbatim or modified copies of this license document\b", "everyone verbatim"),
    ("sqlite-blessing", r"\bmay you do good and not evil may you find forgiveness for yourself\b", "evil forgiveness"),
    ("json", r"\bthe software shall be used for good not evil\b", "good evil"),
    ("beerware", r"\bif we meet some day and you think this stuff is worth it you can buy me a beer\b", "stuff beer"),
    ("public-domain", r"\bthe author hereby disclaims copyright to this source code\b", "hereby disclaims"),
    ("public-domain", r"\bno rights reserved\b", "rights reserved"),
    ("us-government-work", r"\bwork of the (?:u s|united states) government (?:and )?is not subject to copyright protection\b", "government protection"),
    # Creative Commons
    ("cc-by", r"\blicensed under a creative commons attribution (?:\d \d )?(?:international|unported|generic)\b", "creative attribution"),
    ("cc-by-sa", r"\blicensed under a creative commons attribution share ?alike (?:\d \d )?(?:international|unported|generic)\b", "creative attribution"),
    ("cc-by-nc", r"\blicensed under a creative commons attribution non ?commercial (?:\d \d )?(?:international|unported|generic)\b", "creative attribution"),
    ("cc-by-nc-sa", r"\blicensed under a creative commons attribution non ?commercial share ?alike\b", "creative attribution"),
    ("cc-by-nc-nd", r"\blicensed under a creative commons attribution non ?commercial no ?derivatives\b", "creative attribution"),
    ("cc", r"\bsome rights reserved\b", "rights reserved"),
    # Data, fonts, models
    ("ofl-1.1", r"\bthis font software is licensed under the sil open font license version 1 1\b", "licensed font"),
    ("ofl", r"\bthe font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces\b", "larger typefaces"),
    ("bitstream-vera", r"\bthe names bitstream and vera\b", "bitstream vera"),
    ("ubuntu-font", r"\bubuntu font licen[cs]e\b", "ubuntu font"),
    ("odbl", r"\bmade available under the open database license\b", "available database"),
    ("odc-by", r"\bmade available under the open data commons attribution license\b", "available commons"),
    ("pddl", r"\bmade available under the public domain dedication and license\b", "available dedication"),
    ("cdla", r"\bcommunity data license agreement\b", "community agreement"),
    ("rail", r"\b(?:creativeml )?open ?rail(?: m| s)?\b", "rail"),
    ("ogl-uk", r"\bopen government licen[cs]e\b", "open government"),
    # Source available and proprietary
    ("busl-1.1", r"\blicensor hereby grants you the right to copy modify create derivative works redistribute and make non production use\b", "licensor derivative"),
    ("sspl-1.0", r"\bif you make the functionality of the program or a modified version available to third parties as a service\b", "functionality service"),
    ("elastic-2.0", r"\belastic license 2 0\b", "elastic license"),
    ("elastic-2.0", r"\byou may not provide the software to third parties as a hosted or managed service\b", "provide hosted"),
    ("commons-clause", r"\bcommons clause license condition\b", "commons condition"),
    ("commons-clause", r"\bthe grant of rights under the license will not include and the license does not grant to you the right to sell the software\b", "grant sell"),
    ("polyform", r"\bpolyform (?:noncommercial|small business|strict|shield|perimeter) license\b", "polyform license"),
    ("proprietary", r"\bthis (?:document|software|material|file) (?:is|contains) (?:the )?(?:confidential|proprietary)\b", "this"),
    ("proprietary", r"\bno part of this (?:publication|book|document|work|website|software) may be (?:reproduced|copied|stored|transmitted)\b", "part this"),
    ("proprietary", r"\bfor internal use only\b", "internal"),
    ("proprietary", r"\btrade secrets? of\b", "trade secret"),
    ("proprietary", r"\bsubject to the terms of (?:your|the|an?) (?:end user )?license agreement\b", "subject agreement"),
    ("personal-use", r"\bfor personal (?:and )?non ?commercial use only\b", "personal commercial"),
    ("evaluation", r"\bfor evaluation purposes only\b", "evaluation purposes"),
    ("freeware", r"\bthis (?:program|software) is freeware\b", "freeware"),
    ("shareware", r"\bthis (?:program|software) is shareware\b", "shareware"),
    ("commercial", r"\bcommercial licen[cs]es? (?:is|are) available\b", "commercial available"),
    ("dual", r"\bdual licensed under\b", "dual licensed"),
    ("dual", r"\bat your option under (?:either|the terms of either)\b", "option either"),
]
