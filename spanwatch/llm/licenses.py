"""License scans with ordered signature rules, in DataFrame functions only.

A text is lower-cased (A-Z), reduced to its words with one blank between, and scanned. Documents
without a trigger are done after that. Others are tested for the rules' keywords, and only rules
of which a keyword is there run their regular expression. Detections are intervals of words; one that lies
inside another of the same or a stronger priority is suppressed. Base phrases are counted
apart and always keep their labels. Work is linear in the length of a text and in its matches (sorting aside).
"""

from __future__ import annotations

import json
import re
import string
from functools import cache, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    label: str
    priority: int  # 1 is strongest
    keywords: tuple[str, ...]  # every match holds one of these
    pattern: str  # over words with one blank between


# Phrases and labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label, keyword, how the license is named, SPDX identifier as words, part of its address as words.
FAMILIES = (
    ("agpl-3.0", "agpl", r"agpl ?(?:version )?v?3(?: 0)?", "agpl 3 0", "gnu org licenses agpl 3 0"),
    ("agpl-3.0", "affero", r"gnu affero general public licen[sc]e(?: version 3| v3)?", "agpl 3 0 or later", "gnu org licenses agpl"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[sc]e(?: version| v)? ?2 1", "lgpl 2 1", "gnu org licenses lgpl 2 1"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public licen[sc]e(?: version| v)? ?3(?: 0)?", "lgpl 3 0", "gnu org licenses lgpl 3 0"),
    ("lgpl", "lgpl", r"lgpl(?: ?v?[23](?: [01])?)?", "lgpl 2 0", "gnu org licenses lgpl"),
    ("lgpl", "library general", r"gnu library general public licen[sc]e", "lgpl 2 0 or later", "gnu org licenses old licenses lgpl"),
    ("gpl-2.0", "general public", r"gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version |v)2(?: 0)?", "gpl 2 0", "gnu org licenses gpl 2 0"),
    ("gpl-3.0", "general public", r"gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version |v)3(?: 0)?", "gpl 3 0", "gnu org licenses gpl 3 0"),
    ("gpl-2.0", "gpl", r"gpl ?(?:version )?v?2(?: 0)?", "gpl 2 0 only", "gnu org licenses old licenses gpl 2 0"),
    ("gpl-3.0", "gpl", r"gpl ?(?:version )?v?3(?: 0)?", "gpl 3 0 or later", "gnu org licenses gpl"),
    ("gfdl", "free documentation", r"gnu free documentation licen[sc]e", "gfdl 1 3", "gnu org licenses fdl"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[sc]e)? (?:version |v)?2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e (?:version |v)?1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache", "asl", r"asl 2 0", "apache 1 0", "apache org licenses"),
    ("mit", "mit", r"mit(?: x11| expat)?(?: style)?", "mit", "opensource org licenses mit"),
    ("mit", "expat", r"expat(?: mit)?(?: style)?", "expat", "directory fsf org wiki license expat"),
    ("mit", "x11", r"x11(?: style)?", "x11", "opensource org license mit"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd)", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause", "opensource org licenses bsd license"),
    ("0bsd", "bsd", r"(?:zero clause bsd|0bsd|bsd zero clause)", "0bsd", "opensource org licenses 0bsd"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("mpl-2.0", "mpl", r"mpl ?v?2(?: 0)?", "mpl 2 0 no copyleft exception", "mozilla org en us mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("cpl-1.0", "common public", r"common public licen[sc]e", "cpl 1 0", "opensource org licenses cpl1 0"),
    ("eupl-1.2", "european union", r"european union public licen[sc]e", "eupl 1 2", "joinup ec europa eu software page eupl"),
    ("isc", "isc", r"isc", "isc", "opensource org licenses isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "zlib", "zlib net zlib license"),
    ("boost-1.0", "boost", r"boost software licen[sc]e(?: version 1 0)?", "bsl 1 0", "boost org license 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?: 2 0)?", "artistic 2 0", "opensource org licenses artistic license 2 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl", "wtfpl net"),
    ("python-2.0", "python software", r"python software foundation licen[sc]e", "python 2 0", "python org psf license"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: version 1 1)?", "ofl 1 1", "scripts sil org ofl"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql", "opensource org licenses postgresql"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", "ms pl", "opensource org licenses ms pl"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0", "creativecommons org publicdomain zero"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1234] [05])?", "cc by nc nd 4 0", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1234] [05])?", "cc by nc sa 4 0", "creativecommons org licenses by nc sa"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1234] [05])?", "cc by nc 4 0", "creativecommons org licenses by nc"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1234] [05])?", "cc by nd 4 0", "creativecommons org licenses by nd"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1234] [05])?", "cc by sa 4 0", "creativecommons org licenses by sa"),
    ("cc-by-4.0", "cc by", r"cc by 4 0", "cc by 4 0", "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "cc by", r"cc by 3 0", "cc by 3 0", "creativecommons org licenses by 3 0"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1234] [05])?(?: international| unported)?", "cc by 2 0", "creativecommons org licenses by"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1234] [05])?", "cc by sa 3 0", "creativecommons org licenses by sa 3 0"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1234] [05])?", "cc by nc 3 0", "creativecommons org licenses by nc 3 0"),
)
# Ways to state a license; {} is its name.
FORMS = (
    (2, r"(?:dual |re)?licen[sc]ed (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}(?: licen[sc]e)?"),
    (2, r"(?:released|distributed|available|published|provided|made available) under (?:the )?(?:terms of (?:the )?)?{}(?: licen[sc]e)?"),
    (2, r"subject to (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}(?: licen[sc]e)?"),
    (2, r"licen[sc]e {}(?: licen[sc]e)?"),
    (3, r"{} licen[sc]e"),
)
# Sentences that grant, keep or refuse rights: label, keywords (every match holds one of them), expression.
NOTICES = (
    # permissive grants
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files(?: the software)?)?"),
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", "in no event shall the authors", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction(?: \S+){20,45}? to do so the software is provided as is"),
    ("x11", "name of the x consortium", r"except as contained in this notice the name of the x consortium shall not be used"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "source code must retain", r"redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "binary form must reproduce", r"redistributions in binary form must reproduce the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause-patent", "perpetual worldwide", r"each copyright holder and contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: \S+){0,12} patent licen[sc]e"),
    ("bsd", "contributors as is", r"this software is provided by the (?:copyright holders|regents|authors?) and contributors as is and any express or implied warranties"),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "author disclaims all", r"the software is provided as is and (?:the )?author disclaims all warranties with regard to this software"),
    ("hpnd", "permission to use copy", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is hereby granted"),
    ("hpnd-sell", "permission to use copy", r"permission to use copy modify distribute and sell this software and its documentation for any purpose"),
    ("ntp", "permission to use copy", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("zlib", "without any express", r"(?:this software is )?provided as is without any express or implied warranty"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost-1.0", "boost software", r"distributed under the boost software licen[sc]e(?: version 1 0)?(?: see accompanying file licen[sc]e 1 0 txt)?"),
    ("boost-1.0", "machine executable", r"unless such copies or derivative works are solely in the form of machine executable object code"),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you want to public", r"do what the \S+ you want to public licen[sc]e"),
    ("beerware", "buy me a beer", r"you think this stuff is worth it you can buy me a beer(?: in return)?"),
    ("json", "used for good not evil", r"the software shall be used for good not evil"),
    ("curl", "permission to use copy", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("ncsa", "deal with the software", r"to deal with the software without restriction including without limitation the rights to use"),
    ("fsf-unlimited", "unlimited permission", r"(?:the author|free software foundation) gives unlimited permission to copy and or distribute it"),
    ("fsf-all-permissive", "copying and distribution of this file", r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("openssl", "eric young", r"this product includes (?:cryptographic )?software written by eric young"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", r"portions of this software are copyright c? ?(?:\d+ )?the freetype project"),
    # apache
    ("apache-2.0", "except in compliance with the licen", r"you may not use this (?:file|work|software) except in compliance with the licen[sc]e"),
    ("apache-2.0", "distributed on an as is basis", r"software distributed under the licen[sc]e is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "contributor licen", r"licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-2.0", "you may obtain a copy of the licen", r"you may obtain a copy of the licen[sc]e at http www apache org licenses license 2 0"),
    ("apache-2.0", "specific language governing", r"see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e"),
    # copyleft
    ("gpl", "free software foundation", r"(?:as )?published by the free software foundation"),
    ("gpl", "redistribute it and or modify", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-2.0-or-later", "any later version", r"either version 2(?: of the licen[sc]e)? or at your option any later version"),
    ("gpl-3.0-or-later", "any later version", r"either version 3(?: of the licen[sc]e)? or at your option any later version"),
    ("lgpl-2.1-or-later", "any later version", r"either version 2 1(?: of the licen[sc]e)? or at your option any later version"),
    ("gpl", "hope that it will be useful", r"distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "copy of the gnu general public", r"you should have received a copy of the gnu general public licen[sc]e"),
    ("lgpl", "copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("lgpl", "copy of the gnu library", r"you should have received a copy of the gnu library general public licen[sc]e"),
    ("agpl-3.0", "copy of the gnu affero", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("gpl-classpath", "special exception", r"as a special exception the copyright holders of this library give you permission to link this library"),
    ("gpl-gcc-exception", "runtime library exception", r"(?:the )?gcc runtime library exception"),
    ("gpl-autoconf", "special exception", r"as a special exception(?: to the gnu general public licen[sc]e)? if you distribute this file as part of a program that contains a configuration script"),
    ("gpl-bison", "special exception", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-linking", "special exception", r"as a special exception if you link this library with other files"),
    ("gfdl", "copy distribute and or modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("gfdl-no-invariants", "no invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-1.1", "contents of this file are subject", r"the contents of this file are subject to the mozilla public licen[sc]e(?: version)? 1 1"),
    ("mpl-2.0", "source code form is subject", r"this source code form is subject to the terms of the mozilla public licen[sc]e(?: v 2 0)?"),
    ("mpl-2.0", "incompatible with secondary", r"this source code form is incompatible with secondary licen[sc]es"),
    ("npl-1.1", "netscape public", r"the contents of this file are subject to the netscape public licen[sc]e"),
    ("cddl-1.0", "subject to the terms of the common development", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("epl-1.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0"),
    ("epl-2.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v )?2 0"),
    ("eupl-1.2", "licensed under the eupl", r"licensed under the eupl"),
    ("osl-3.0", "open software licen", r"licen[sc]ed under the open software licen[sc]e version 3 0"),
    # domain and content
    ("public-domain", "public domain", r"(?:released|placed|dedicated|put) (?:in|in to|into|to) the public domain"),
    ("public-domain", "public domain", r"(?:is|are) (?:hereby )?in the public domain"),
    ("public-domain", "public domain", r"(?:author|creator|contributors?)(?: of this \S+)? (?:hereby )?disclaims? copyright(?: to this source code)?(?: \S+){0,10} public domain"),
    ("sqlite-blessing", "in place of a legal notice", r"in place of a legal notice here is a blessing"),
    ("cc0-1.0", "waived all copyright", r"has waived all copyright and related or neighbou?ring rights"),
    ("cc0-1.0", "public domain dedication", r"(?:cc0 )?1 0 universal(?: cc0 1 0)? public domain dedication"),
    ("cc-by", "creative commons attribution", r"this work is licen[sc]ed under (?:a |the )?creative commons attribution"),
    ("cc-by-nc", "non commercial purposes", r"you may (?:copy|share|use)(?: \S+){0,6} for non commercial purposes(?: only)?"),
    ("odbl", "open database licen", r"(?:is )?made available under the open database licen[sc]e"),
    # rights kept
    ("proprietary", "all rights reserved", r"copyright(?: c)? (?:\S+ ){1,8}all rights reserved"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary and confidential", r"(?:is |are )?(?:strictly )?proprietary and confidential"),
    ("proprietary", "confidential and proprietary", r"confidential and proprietary(?: information)?"),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|reproduction|use|distribution|duplication)(?: \S+){0,6} (?:is )?(?:strictly )?prohibited"),
    ("proprietary", "be reproduced", r"(?:no part of this \S+ may be reproduced|may not be reproduced)(?: \S+){0,12} without (?:the )?(?:prior |express )?(?:written )?permission"),
    ("proprietary", "no part of this", r"no part of this \S+ may be (?:reproduced|copied|distributed)"),
    ("proprietary", "end user licen", r"end user licen[sc]e agreement"),
    ("proprietary", "licensed not sold", r"(?:is |are )?licensed not sold"),
    ("proprietary", "trade secret", r"contains (?:valuable )?trade secrets?(?: and proprietary information)? of"),
    ("copyleft-next", "copyleft next", r"licen[sc]ed under (?:the )?copyleft next"),
    ("elastic-2.0", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1.0", "functionality of the program", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "change date", r"effective on the change date(?: \S+){0,24} change licen[sc]e"),
    ("commons-clause", "commons clause", r"commons clause licen[sc]e condition"),
    ("commons-clause", "right to sell the software", r"the licen[sc]e does not grant to you(?: and you are not granted)? the right to sell the software"),
    ("polyform-noncommercial", "polyform noncommercial", r"polyform noncommercial licen[sc]e(?: 1 0 0)?"),
    ("hippocratic", "hippocratic", r"hippocratic licen[sc]e(?: \d+(?: \d+)?)?"),
    # choices and pointers
    ("dual-mit-apache", "dual licensed", r"dual licensed under (?:the )?(?:mit and apache|apache and mit|apache 2 0 and mit|mit and apache 2 0)"),
    ("dual-mit-gpl", "dual licensed", r"dual licensed under (?:the )?(?:mit (?:and|or) gpl|gpl (?:and|or) mit)"),
    ("dual-mit-apache", "at your option", r"licen[sc]ed under either of (?:the )?apache licen[sc]e(?: \S+){0,12} mit licen[sc]e(?: \S+){0,8} at your option"),
    ("spdx-or", "spdx", r"spdx licen[sc]e identifier (?:\S+ ){1,6}or (?!later)\S+"),
    ("spdx-and", "spdx", r"spdx licen[sc]e identifier (?:\S+ ){1,6}and \S+"),
    ("spdx-with", "spdx", r"spdx licen[sc]e identifier (?:\S+ ){1,6}with (?:\S+ ){0,3}exception"),
    ("see-file", "in the root directory", r"(?:bsd|mit|apache)(?: style)? licen[sc]e(?: that can be)? found in the licen[sc]e file in the root directory of this source tree"),
    ("bsd-style", "bsd style licen", r"governed by a bsd style licen[sc]e(?: that can be found in the licen[sc]e file)?"),
    ("see-file", "copying|licen", r"see (?:the )?(?:file )?(?:licen[sc]e|copying)(?: txt| md)? file for (?:more )?(?:details|information|licen[sc]e terms)"),
)
# Licenses by name only: label, keywords, expression.
NAMES = (
    ("afl-3.0", "academic free", r"academic free licen[sc]e(?: version)?(?: v?[123](?: [0-9])?)?"),
    ("adaptive-public", "adaptive public", r"adaptive public licen[sc]e"),
    ("aladdin", "aladdin free", r"aladdin free public licen[sc]e"),
    ("apsl-2.0", "apple public source", r"apple public source licen[sc]e(?: [12](?: [0-9])?)?"),
    ("artistic-1.0", "artistic licen", r"artistic licen[sc]e 1 0"),
    ("beerware", "beer", r"beer ?ware licen[sc]e"),
    ("blue-oak", "blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?"),
    ("busl-1.1", "business source", r"business source licen[sc]e(?: 1 1)?"),
    ("bittorrent", "bittorrent open", r"bittorrent open source licen[sc]e"),
    ("cecill-2.1", "cecill", r"cecill(?: [bc])?(?: free software)? licen[sc]e(?: agreement)?"),
    ("cpal-1.0", "common public attribution", r"common public attribution licen[sc]e"),
    ("cua-opl", "cua office", r"cua office public licen[sc]e"),
    ("cdla-permissive", "community data", r"community data licen[sc]e agreement permissive"),
    ("cdla-sharing", "community data", r"community data licen[sc]e agreement sharing"),
    ("cern-ohl", "cern open hardware", r"cern open hardware licen[sc]e"),
    ("ecl-2.0", "educational community", r"educational community licen[sc]e"),
    ("efl-2.0", "eiffel forum", r"eiffel forum licen[sc]e"),
    ("elastic-2.0", "elastic licen", r"elastic licen[sc]e(?: 2 0)?"),
    ("entessa", "entessa public", r"entessa public licen[sc]e"),
    ("etalab-2.0", "etalab", r"etalab open licen[sc]e(?: 2 0)?"),
    ("fair", "fair licen", r"the fair licen[sc]e"),
    ("frameworx", "frameworx", r"frameworx(?: open)? licen[sc]e"),
    ("free-art", "free art licen", r"free art licen[sc]e(?: 1 3)?"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer licen[sc]e"),
    ("ibm-pl", "ibm public", r"ibm public licen[sc]e"),
    ("icu", "icu licen", r"icu licen[sc]e"),
    ("imagemagick", "imagemagick", r"imagemagick licen[sc]e"),
    ("intel", "intel open source", r"intel open source licen[sc]e"),
    ("ipa", "ipa font", r"ipa font licen[sc]e"),
    ("jabber", "jabber open", r"jabber open source licen[sc]e"),
    ("lppl-1.3c", "latex project", r"latex project public licen[sc]e"),
    ("lpl-1.02", "lucent public", r"lucent public licen[sc]e"),
    ("liliq", "liliq", r"liliq (?:p|r|rplus)(?: 1 1)? licen[sc]e"),
    ("llama", "llama", r"llama(?: \d)?(?: \d)? community licen[sc]e"),
    ("openrail", "openrail|open rail", r"(?:creativeml |bigscience )?open ?rail(?: m)? licen[sc]e"),
    ("miros", "miros licen", r"miros licen[sc]e"),
    ("motosoto", "motosoto", r"motosoto open source licen[sc]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e"),
    ("mulan-2.0", "mulan", r"mulan (?:permissive software licen[sc]e|psl)(?: v?2)?"),
    ("multics", "multics licen", r"multics licen[sc]e"),
    ("nasa-1.3", "nasa open source", r"nasa open source (?:agreement|licen[sc]e)"),
    ("naumen", "naumen public", r"naumen public licen[sc]e"),
    ("nokia", "nokia open source", r"nokia open source licen[sc]e"),
    ("nposl-3.0", "non profit open software", r"non profit open software licen[sc]e"),
    ("oclc-2.0", "oclc research", r"oclc research public licen[sc]e"),
    ("odbl", "open database", r"open database licen[sc]e(?: odbl)?"),
    ("odc-by", "open data commons attribution", r"open data commons attribution licen[sc]e"),
    ("pddl", "public domain dedication and licen", r"public domain dedication and licen[sc]e"),
    ("ogl-uk", "open government", r"open government licen[sc]e(?: v?[123](?: 0)?)?"),
    ("ogtsl", "open group test", r"open group test suite licen[sc]e"),
    ("openldap", "openldap public", r"openldap public licen[sc]e"),
    ("openssl", "openssl licen", r"openssl licen[sc]e"),
    ("osl-3.0", "open software licen", r"open software licen[sc]e(?: v?[123](?: [01])?)?"),
    ("parity", "parity public", r"parity public licen[sc]e"),
    ("php-3.01", "php licen", r"php licen[sc]e(?: version)?(?: 3(?: 0?1)?)?"),
    ("prosperity", "prosperity public", r"prosperity public licen[sc]e"),
    ("qpl-1.0", "q public", r"q public licen[sc]e"),
    ("rpsl-1.0", "realnetworks public", r"realnetworks public source licen[sc]e"),
    ("rpl-1.5", "reciprocal public", r"reciprocal public licen[sc]e"),
    ("ricoh", "ricoh source", r"ricoh source code public licen[sc]e"),
    ("ruby", "ruby", r"(?:the )?ruby licen[sc]e|same terms as ruby(?: itself)?"),
    ("sissl", "sun industry standards", r"sun industry standards source licen[sc]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"),
    ("solderpad", "solderpad", r"solderpad hardware licen[sc]e"),
    ("spl-1.0", "sun public", r"sun public licen[sc]e"),
    ("sspl-1.0", "server side public", r"server side public licen[sc]e(?: v1)?"),
    ("simpl-2.0", "simple public", r"simple public licen[sc]e"),
    ("tapr-ohl", "tapr open hardware", r"tapr open hardware licen[sc]e"),
    ("tcl", "tcl", r"tcl tk licen[sc]e|tcl licen[sc]e"),
    ("unicode", "unicode licen", r"unicode licen[sc]e(?: agreement)?"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e(?: v ?1 0)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e"),
    ("vim", "vim licen", r"vim licen[sc]e"),
    ("vsl-1.0", "vovida software", r"vovida software licen[sc]e"),
    ("w3c", "w3c", r"w3c software(?: notice and)? licen[sc]e"),
    ("watcom-1.0", "sybase open watcom", r"sybase open watcom public licen[sc]e"),
    ("wxwindows", "wxwindows", r"wxwindows library licen[sc]e"),
    ("xnet", "x net licen", r"x net licen[sc]e"),
    ("xfree86-1.1", "xfree86", r"xfree86(?: project)? licen[sc]e"),
    ("zend-2.0", "zend engine", r"zend engine licen[sc]e"),
    ("zpl-2.1", "zope public", r"zope public licen[sc]e(?: version)?(?: 2 [01])?"),
)


def rules() -> list[Rule]:
    """All rules, in order. Weak forms are left out for names that already end in "license"."""
    out = []
    for label, keyword, name, spdx, address in FAMILIES:
        out.append(Rule(label, 1, ("spdx",), f"spdx licen[sc]e identifier {spdx}"))
        out.append(Rule(label, 1, (address.split()[0],), address))
        for priority, form in FORMS:
            out.append(Rule(label, priority, (keyword,), form.replace("{}", f"(?:{name})")))
        if "licen" in name:
            out.append(Rule(label, 3, (keyword,), name))
    for label, keyword, pattern in NOTICES:
        out.append(Rule(label, 3 if pattern == "all rights reserved" else 2, tuple(keyword.split("|")), pattern))
    return out + [Rule(label, 3, tuple(keyword.split("|")), pattern) for label, keyword, pattern in NAMES]


#: Every rule's match, and every base phrase, holds one of these.
TRIGGERS = (
    "licen", " cc ", "spdx", "gpl", "copyright", "public domain", "redistribution", "permission", "free software", "warranty", " org ", " net ", " eu ", "rights reserved", " under ", " subject to ",
    "permitted", "provided", "software", "prohibited", "proprietary", "trade secret", "reproduced", "commons", "no invariant", "any later version", "special exception", "runtime library exception", "same terms as ruby",
    "version 2", "v2", "apache 2", "notice", "contributors", "functionality of the program", "non commercial", "nasa open source", "mulan psl", "copying", "no part of this", "legal notice", "in no event", "liable", "unless such copies", "worth it you can",
)
WEIGHTS = {1: 1.0, 2: 0.9, 3: 0.7}
BASE_WEIGHT = 0.8


def words_of(text: Column) -> Column:
    """The words of a text with one blank around each, or one blank if there is none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _blanks(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def places(norm: Column, pattern: Column) -> Column:
    """array<struct<s, e>>: first word of each match, and the word after its last.

    Matches are marked in the text, and the marked words' numbers are read off one split of it."""
    marked = F.regexp_replace(norm, F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )")), F.lit("\u0001$0\u0002"))
    at = lambda test, shift: F.filter(F.transform(F.split(marked, " "), lambda w, i: F.when(test(w), i + shift)), lambda i: i.isNotNull())
    begins, ends = at(lambda w: w.startswith("\u0001"), -1), at(lambda w: w.endswith("\u0002"), 0)
    found = F.zip_with(begins, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    return F.when(marked.contains("\u0001"), found).otherwise(F.expr("cast(array() as array<struct<s:int,e:int>>)"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest
    of their starts (null if none); base_labels and labels (with the rules' labels that stand) are
    distinct, sorted and comma-joined, empty if there are none. score is the weight of the strongest
    detection that stands, 0 if none. Null and empty texts have no words. Repeated rows are repeated; an empty
    table gives an empty result. Very long texts are scanned whole: time grows with their length. Further columns are
    ignored, whatever their names. No shuffle: each row is scanned where it is read.
    """
    every = rules()
    keywords = sorted({k for r in every for k in r.keywords})
    d = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("norm"))
    has = lambda literal: F.col("norm").contains(literal)
    d = d.withColumn("open", reduce(lambda a, b: a | b, [has(t) for t in TRIGGERS]))
    keys = F.filter(F.split(F.lit("|".join(keywords)), "\\|"), lambda k: F.col("norm").contains(k))
    d = d.withColumn("keys", F.when(F.col("open"), keys))
    no_places = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    base = F.array(*[F.struct(F.lit(label).alias("label"), F.when(has(f" {p} "), places(F.col("norm"), F.lit(p))).otherwise(no_places).alias("at")) for p, label in BASE_PHRASES.items()])
    d = d.withColumn("base", F.when(F.col("open"), F.filter(base, lambda b: F.size(b["at"]) > 0)))
    listed = json.dumps([r._asdict() | {"n": n} for n, r in enumerate(every)])  # one constant, folded when the plan is made
    table = F.from_json(F.lit(listed), "array<struct<label:string,priority:int,keywords:array<string>,pattern:string,n:int>>")
    gated = F.filter(table, lambda r: F.arrays_overlap(F.col("keys"), r["keywords"]))
    found = F.flatten(
        F.transform(gated, lambda r: F.transform(places(F.col("norm"), r["pattern"]), lambda p: F.struct(p["s"].alias("s"), (-p["e"]).alias("to"), r["priority"].alias("priority"), r["n"].alias("n"), r["label"].alias("label"))))
    )
    d = d.withColumn("found", F.when(F.size("keys") > 0, F.array_sort(found)))
    # in order of start, longest and strongest first, whatever contains a detection comes before it
    start = F.struct(F.lit(0).alias("e1"), F.lit(0).alias("e2"), F.lit(0).alias("e3"), F.lit(9).alias("best"), F.expr("cast(array() as array<string>)").alias("labels"))

    def stand(acc, x):
        reach = F.when(x["priority"] == 1, acc["e1"]).when(x["priority"] == 2, acc["e2"]).otherwise(acc["e3"])
        end = -x["to"]
        return F.when(end <= reach, acc).otherwise(
            F.struct(
                F.when(x["priority"] <= 1, F.greatest(acc["e1"], end)).otherwise(acc["e1"]).alias("e1"), F.when(x["priority"] <= 2, F.greatest(acc["e2"], end)).otherwise(acc["e2"]).alias("e2"),
                F.greatest(acc["e3"], end).alias("e3"), F.least(acc["best"], x["priority"]).alias("best"), F.array_union(acc["labels"], F.array(x["label"])).alias("labels"),
            )
        )

    d = d.withColumn("stands", F.when(F.size("found") > 0, F.aggregate("found", start, stand)))
    starts = F.flatten(F.transform("base", lambda b: F.transform(b["at"], lambda p: p["s"])))
    own = F.coalesce(F.transform("base", lambda b: b["label"]), F.expr("cast(array() as array<string>)"))
    theirs = F.coalesce(F.col("stands.labels"), F.expr("cast(array() as array<string>)"))
    weight = F.when(F.col("stands.best") == 1, WEIGHTS[1]).when(F.col("stands.best") == 2, WEIGHTS[2]).when(F.col("stands.best") == 3, WEIGHTS[3]).otherwise(0.0)
    return d.select(
        "doc_id", (_blanks(F.col("norm")) - 1).cast("long").alias("n_words"), F.coalesce(F.size(starts), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(own, theirs)), ",").alias("labels"),
        F.greatest(weight, F.when(F.size(own) > 0, BASE_WEIGHT).otherwise(0.0)).alias("score"),
    )


@cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(f"(?<= )(?:{pattern})(?= )")


def scan_text(text: str | None) -> tuple:
    """The same for one text in plain Python, for tests: every rule without keywords or triggers, every
    detection against every other."""
    lower = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    norm = " ".join(["", *words, ""]) if words else " "
    find = lambda p: [(norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" ")) for m in _compiled(p).finditer(norm)]
    base = {p: find(re.escape(p)) for p in BASE_PHRASES}
    starts = [s for at in base.values() for s, _ in at]
    found = [(s, -e, r.priority, n, r.label) for n, r in enumerate(rules()) for s, e in find(r.pattern)]
    stand = [x for x in found if not any(y < x and y[1] <= x[1] and y[2] <= x[2] for y in found)]
    own = {BASE_PHRASES[p] for p, at in base.items() if at}
    best = max([WEIGHTS[x[2]] for x in stand] + [BASE_WEIGHT] * bool(own), default=0.0)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[4] for x in stand})), best
