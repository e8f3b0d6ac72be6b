"""Signature rules of the license scan: (label, priority, gate phrases, regular expression).

A rule is written over normalised text: lower-case words with one space between
them. ``[^ ]+`` stands for any word. A smaller priority wins:

0 base phrases (never suppressed), 1 identifiers and grants with a version,
2 names with a version or a whole notice, 3 names alone, 4 hints.

A gate lists phrases of which one must occur, word for word, before the regular
expression is tried. The expressions use only what Java's and RE2's syntax share.
"""
from __future__ import annotations

# Confidence of a detection by priority.
WEIGHTS = [0.5, 1.0, 0.8, 0.6, 0.4]

# The base phrases and their labels.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

# Identifiers that follow "SPDX-License-Identifier:"; a rule is made of each.
SPDX = """
0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0
BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1
CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1
CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2
GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IPL-1.0 ISC
LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0
MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 ODC-By-1.0 OFL-1.1 OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0
Ruby SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()

_LIC = "licen[cs]e"
_UNDER = "(licensed|released|distributed|available|published|provided)( [^ ]+){0,3} under( the)?( terms of( the)?)?"

# Hand-written signatures.
SIGNATURES = [
    # Apache
    ("apache-2.0", 1, ["apache"], f"{_UNDER} apache( software)? {_LIC}( version| v)? ?2( 0)?"),
    ("apache-2.0", 2, ["apache"], f"apache( software)? {_LIC}( version)? v?2( 0)?"),
    ("apache-2.0", 2, ["apache"], "apache 2( 0)?"),
    ("apache-2.0", 2, ["apache"], "apache org licenses license 2 0"),
    ("apache-1.1", 2, ["apache"], f"apache( software)? {_LIC}( version)? 1 1"),
    ("apache-1.0", 2, ["apache"], f"apache( software)? {_LIC}( version)? 1 0"),
    ("apache", 3, ["apache"], f"apache( software)? {_LIC}"),
    ("apache", 3, ["apache"], f"{_UNDER} apache"),
    ("apache", 3, ["apache"], f"{_LIC} apache"),
    ("apache", 4, ["asl 2", "asl2"], "asl ?2( 0)?"),
    # MIT and relatives
    ("mit", 1, ["mit"], f"{_UNDER} mit( x11| expat)? {_LIC}"),
    ("mit", 2, ["mit license", "mit licence"], f"the mit {_LIC} mit"),
    ("mit", 3, ["mit license", "mit licence"], f"mit {_LIC}"),
    ("mit", 3, ["expat license", "expat licence"], f"expat {_LIC}"),
    ("mit", 3, ["licensed mit", "license mit", "licence mit"], f"(licensed|{_LIC}) mit"),
    ("mit", 3, ["mit lizenz"], "mit lizenz"),
    ("mit", 2, ["permission is hereby granted"],
     "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-0", 2, ["mit 0", "mit no attribution"], "mit (0|no attribution)"),
    ("x11", 3, ["x11"], f"x11 {_LIC}"),
    ("isc", 2, ["permission to use copy modify"],
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 3, ["isc license", "isc licence"], f"isc {_LIC}"),
    ("hpnd", 2, ["permission to use copy modify"],
     "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("ncsa", 3, ["ncsa"], f"(university of illinois )?ncsa( open source)? {_LIC}"),
    ("boost-1.0", 2, ["boost"], f"boost software {_LIC}( version)?( 1 0)?"),
    ("boost-1.0", 3, ["boost org"], "boost org license 1 0"),
    ("zlib", 3, ["zlib"], f"zlib( libpng)? {_LIC}"),
    ("zlib", 2, ["provided as is without any express"], "this software is provided as is without any express or implied warranty"),
    ("unlicense", 2, ["unlicense"], "the unlicense"),
    ("unlicense", 3, ["unlicense org", "unlicense"], "unlicense( org)?"),
    ("unlicense", 2, ["free and unencumbered"], "this is free and unencumbered software released into the public domain"),
    ("wtfpl", 3, ["wtfpl"], "wtfpl( version)?( 2)?"),
    ("wtfpl", 2, ["what the"], f"do what the [^ ]+ you want( to)? public {_LIC}"),
    ("beerware", 3, ["beerware", "beer ware"], f"(the )?beer ?ware {_LIC}"),
    ("blue-oak", 3, ["blue oak"], f"blue oak model {_LIC}( 1 0 0)?"),
    ("upl-1.0", 3, ["universal permissive"], f"universal permissive {_LIC}( v| version)?( 1 0)?"),
    # BSD
    ("bsd-2-clause", 1, ["bsd"], f"{_UNDER} (simplified|2 clause|two clause|freebsd) bsd( style)? {_LIC}"),
    ("bsd-2-clause", 2, ["bsd"], "bsd (2|two) clause"),
    ("bsd-2-clause", 2, ["bsd", "freebsd"], f"(simplified bsd|2 clause bsd|two clause bsd|freebsd) {_LIC}"),
    ("bsd-3-clause", 1, ["bsd"], f"{_UNDER} (new|modified|revised|3 clause|three clause) bsd( style)? {_LIC}"),
    ("bsd-3-clause", 2, ["bsd"], "bsd (3|three) clause"),
    ("bsd-3-clause", 2, ["bsd"], f"(new|modified|revised|3 clause|three clause) bsd {_LIC}"),
    ("bsd-4-clause", 2, ["bsd"], "bsd (4|four) clause"),
    ("bsd-4-clause", 2, ["bsd"], f"(original|old|4 clause|four clause) bsd {_LIC}"),
    ("bsd-4-clause", 2, ["all advertising materials"],
     "all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment"),
    ("bsd-0-clause", 2, ["0bsd", "zero clause bsd"], "(0bsd|zero clause bsd)"),
    ("bsd", 3, ["bsd"], f"bsd( style| type| like)? {_LIC}"),
    ("bsd", 3, ["bsd"], f"{_UNDER} bsd"),
    ("bsd", 2, ["redistribution and use in source"],
     "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 2, ["neither the name"],
     "neither the names? of( the)?( [^ ]+){1,12} nor the names of its contributors may be used to endorse"),
    # GNU
    ("gpl-3.0-or-later", 1, ["general public"],
     f"gnu general public {_LIC}( [^ ]+){{0,8}} (version|v) 3( 0)?( of the {_LIC})? or( at your option)? any later"),
    ("gpl-3.0", 1, ["general public"], f"{_UNDER} gnu general public {_LIC}( gpl)?( version| v) ?3( 0)?"),
    ("gpl-3.0", 2, ["general public"], f"(gnu )?general public {_LIC}( gpl)?( version| v)? v?3( 0)?"),
    ("gpl-3.0", 2, ["gpl", "gplv3", "gpl3", "gpl v3"], "(gnu )?gpl ?(version|v)? ?3( 0)?"),
    ("gpl-2.0-or-later", 1, ["general public"],
     f"gnu general public {_LIC}( [^ ]+){{0,8}} (version|v) 2( 0)?( of the {_LIC})? or( at your option)? any later"),
    ("gpl-2.0", 1, ["general public"], f"{_UNDER} gnu general public {_LIC}( gpl)?( version| v) ?2( 0)?"),
    ("gpl-2.0", 2, ["general public"], f"(gnu )?general public {_LIC}( gpl)?( version| v)? v?2( 0)?"),
    ("gpl-2.0", 2, ["gpl", "gplv2", "gpl2", "gpl v2"], "(gnu )?gpl ?(version|v)? ?2( 0)?"),
    ("gpl-1.0", 2, ["general public"], f"(gnu )?general public {_LIC}( version| v)? 1( 0)?"),
    ("gpl", 3, ["general public"], f"gnu general public {_LIC}"),
    ("gpl", 3, ["gnu gpl"], "gnu gpl"),
    ("gpl", 3, ["gpl"], f"(under|{_LIC}|licensed)( the)? gpl"),
    ("gpl", 4, ["gpl"], "gpl"),
    ("gpl", 3, ["licence publique générale", "licence publique generale"], "licence publique g[eé]n[eé]rale( gnu)?"),
    ("gpl", 3, ["licencia pública general"], "licencia pública general( de)?( gnu)?"),
    ("lgpl-3.0", 1, ["lesser general public"], f"{_UNDER} gnu lesser general public {_LIC}( lgpl)?( version| v) ?3( 0)?"),
    ("lgpl-3.0", 2, ["lesser general public"], f"lesser general public {_LIC}( lgpl)?( version| v)? 3( 0)?"),
    ("lgpl-3.0", 2, ["lgpl", "lgplv3", "lgpl3"], "(gnu )?lgpl ?(version|v)? ?3( 0)?"),
    ("lgpl-2.1", 1, ["lesser general public"], f"{_UNDER} gnu lesser general public {_LIC}( lgpl)?( version| v) ?2 1"),
    ("lgpl-2.1", 2, ["lesser general public"], f"lesser general public {_LIC}( lgpl)?( version| v)? 2 1"),
    ("lgpl-2.1", 2, ["lgpl", "lgplv2"], "(gnu )?lgpl ?(version|v)? ?2 1"),
    ("lgpl-2.0", 2, ["library general public"], f"(gnu )?library general public {_LIC}( version| v)?( 2( 0)?)?"),
    ("lgpl", 3, ["lesser general public"], f"(gnu )?lesser general public {_LIC}"),
    ("lgpl", 3, ["lgpl"], "(gnu )?lgpl"),
    ("agpl-3.0", 1, ["affero general public"], f"{_UNDER} gnu affero general public {_LIC}( agpl)?( version| v) ?3( 0)?"),
    ("agpl-3.0", 2, ["affero general public"], f"affero general public {_LIC}( agpl)?( version| v)? 3( 0)?"),
    ("agpl-3.0", 2, ["agpl", "agplv3", "agpl3"], "(gnu )?agpl ?(version|v)? ?3( 0)?"),
    ("agpl", 3, ["affero general public"], f"(gnu )?affero general public {_LIC}"),
    ("agpl", 3, ["agpl"], "(gnu )?agpl"),
    ("gfdl-1.3", 2, ["free documentation"], f"gnu free documentation {_LIC}( version| v)? 1 3"),
    ("gfdl-1.2", 2, ["free documentation"], f"gnu free documentation {_LIC}( version| v)? 1 2"),
    ("gfdl", 3, ["free documentation"], f"(gnu )?free documentation {_LIC}"),
    ("gfdl", 3, ["gfdl", "gnu fdl"], "(gfdl|gnu fdl)"),
    # Mozilla, Eclipse, CDDL and other weak copyleft
    ("mpl-2.0", 1, ["mozilla public"], f"{_UNDER} mozilla public {_LIC}( mpl)?( version| v) ?2( 0)?"),
    ("mpl-2.0", 1, ["mozilla public"], f"subject to the terms of the mozilla public {_LIC} v 2 0"),
    ("mpl-2.0", 2, ["mozilla public"], f"mozilla public {_LIC}( mpl)?( version| v)? v?2( 0)?"),
    ("mpl-2.0", 2, ["mpl"], "mpl ?(version|v)? ?2( 0)?"),
    ("mpl-1.1", 2, ["mozilla public"], f"mozilla public {_LIC}( mpl)?( version| v)? 1 1"),
    ("mpl-1.1", 2, ["mpl"], "mpl ?(version|v)? ?1 1"),
    ("mpl", 3, ["mozilla public"], f"mozilla public {_LIC}"),
    ("epl-2.0", 2, ["eclipse public"], f"eclipse public {_LIC}( epl)?( version| v)? v?2( 0)?"),
    ("epl-1.0", 2, ["eclipse public"], f"eclipse public {_LIC}( epl)?( version| v)? v?1( 0)?"),
    ("epl", 3, ["eclipse public"], f"eclipse public {_LIC}"),
    ("edl-1.0", 3, ["eclipse distribution"], f"eclipse distribution {_LIC}( v| version)?( 1 0)?"),
    ("cddl-1.1", 2, ["common development and distribution"], f"common development and distribution {_LIC}( version| v)? 1 1"),
    ("cddl-1.0", 2, ["common development and distribution"], f"common development and distribution {_LIC}( version| v)? 1 0"),
    ("cddl", 3, ["common development and distribution", "cddl"], f"(common development and distribution {_LIC}|cddl)"),
    ("cpl-1.0", 3, ["common public license", "common public licence"], f"common public {_LIC}( version| v)?( 1 0)?"),
    ("ipl-1.0", 3, ["ibm public"], f"ibm public {_LIC}( version| v)?( 1 0)?"),
    ("cpal-1.0", 3, ["common public attribution"], f"common public attribution {_LIC}"),
    ("eupl-1.2", 2, ["european union public", "eupl"], f"(european union public {_LIC}|eupl)( version| v)? 1 2"),
    ("eupl-1.1", 2, ["european union public", "eupl"], f"(european union public {_LIC}|eupl)( version| v)? 1 1"),
    ("eupl", 3, ["european union public", "eupl"], f"(european union public {_LIC}|eupl)"),
    ("cecill", 3, ["cecill"], f"cecill( {_LIC})?( [bc]|( version)? 2( [01])?)?"),
    ("osl-3.0", 2, ["open software license", "open software licence"], f"open software {_LIC}( version| v)?( 3 0)?"),
    ("afl-3.0", 2, ["academic free"], f"academic free {_LIC}( version| v)?( 3 0)?"),
    ("artistic-2.0", 2, ["artistic license", "artistic licence"], f"artistic {_LIC}( version| v)? 2( 0)?"),
    ("artistic-1.0", 2, ["artistic license", "artistic licence"], f"artistic {_LIC}( version| v)? 1( 0)?"),
    ("artistic", 3, ["artistic license", "artistic licence"], f"artistic {_LIC}"),
    ("perl", 3, ["perl itself", "perl 5 itself"], "(under )?the same terms as perl( 5)? itself"),
    ("python-2.0", 2, ["python software foundation"], f"python software foundation {_LIC}( version| v)?( 2)?"),
    ("psf", 3, ["psf license", "psf licence"], f"psf {_LIC}"),
    ("php-3.01", 3, ["php license", "php licence"], f"php {_LIC}( version| v)?( 3 01)?"),
    ("ruby", 3, ["ruby license", "ruby licence", "ruby s license"], f"ruby( s)? {_LIC}"),
    ("vim", 3, ["vim license", "vim licence"], f"vim {_LIC}"),
    ("postgresql", 3, ["postgresql license", "postgresql licence"], f"postgresql {_LIC}"),
    ("openssl", 3, ["openssl license", "openssl licence"], f"openssl {_LIC}"),
    ("openssl", 2, ["openssl toolkit"], "developed by the openssl project for use in the openssl toolkit"),
    ("qpl-1.0", 3, ["q public"], f"q public {_LIC}( version| v)?( 1 0)?"),
    ("zpl", 3, ["zope public"], f"zope public {_LIC}( version| v)?( 2 [01])?"),
    ("w3c", 3, ["w3c"], f"w3c( software)?( notice and)? {_LIC}"),
    ("ms-pl", 3, ["microsoft public", "ms pl"], f"(microsoft public {_LIC}|ms pl)"),
    ("ms-rl", 3, ["microsoft reciprocal", "ms rl"], f"(microsoft reciprocal {_LIC}|ms rl)"),
    ("apsl-2.0", 3, ["apple public source"], f"apple public source {_LIC}( version| v)?( 2 0)?"),
    ("nposl-3.0", 3, ["non profit open software"], f"non profit open software {_LIC}"),
    ("ecl-2.0", 3, ["educational community"], f"educational community {_LIC}( version| v)?( 2 0)?"),
    ("lppl-1.3c", 3, ["latex project public", "lppl"], f"(latex project public {_LIC}|lppl)( version| v)?( 1 3( ?[a-c])?)?"),
    ("mulan-psl-2.0", 3, ["mulan"], f"mulan( psl|( permissive software)? {_LIC})( v2|( version)? 2)?"),
    ("icu", 3, ["icu license", "icu licence"], f"icu {_LIC}"),
    ("unicode", 3, ["unicode license", "unicode licence", "unicode terms of use"], f"unicode ({_LIC}|terms of use)"),
    ("curl", 3, ["curl license", "curl licence"], f"curl {_LIC}"),
    ("json", 2, ["used for good"], "the software shall be used for good not evil"),
    ("json", 3, ["json license", "json licence"], f"json {_LIC}"),
    ("ofl-1.1", 2, ["open font"], f"(sil )?open font {_LIC}( version| v)?( 1 1)?"),
    ("ofl-1.1", 3, ["sil ofl"], "sil ofl( 1 1)?"),
    # Creative Commons
    ("cc-by-nc-nd-4.0", 1, ["cc by nc nd"], "cc by nc nd 4 0( international)?"),
    ("cc-by-nc-nd", 2, ["cc by nc nd"], "cc by nc nd( [123] [05])?"),
    ("cc-by-nc-sa-4.0", 1, ["cc by nc sa"], "cc by nc sa 4 0( international)?"),
    ("cc-by-nc-sa", 2, ["cc by nc sa"], "cc by nc sa( [123] [05])?"),
    ("cc-by-nc-4.0", 1, ["cc by nc"], "cc by nc 4 0( international)?"),
    ("cc-by-nc", 2, ["cc by nc"], "cc by nc( [123] [05])?"),
    ("cc-by-nd-4.0", 1, ["cc by nd"], "cc by nd 4 0( international)?"),
    ("cc-by-nd", 2, ["cc by nd"], "cc by nd( [123] [05])?"),
    ("cc-by-sa-4.0", 1, ["cc by sa"], "cc by sa 4 0( international)?"),
    ("cc-by-sa-3.0", 1, ["cc by sa"], "cc by sa 3 0( unported)?"),
    ("cc-by-sa", 2, ["cc by sa"], "cc by sa( [12] [05])?"),
    ("cc-by-4.0", 1, ["cc by 4"], "cc by 4 0( international)?"),
    ("cc-by-3.0", 1, ["cc by 3"], "cc by 3 0( unported)?"),
    ("cc-by-2.0", 1, ["cc by 2"], "cc by 2 [05]( generic)?"),
    ("cc0-1.0", 2, ["cc0"], "cc0( 1 0)?( universal)?"),
    ("cc0-1.0", 2, ["cc zero"], "cc zero( 1 0)?"),
    ("cc-by-nc-nd-4.0", 1, ["creative commons"], f"creative commons attribution noncommercial no ?derivatives 4 0( international)?( public)?( {_LIC})?"),
    ("cc-by-nc-nd", 2, ["creative commons"], f"creative commons attribution non ?commercial no ?deriv(ative)?s( [123] [05])?( {_LIC})?"),
    ("cc-by-nc-sa-4.0", 1, ["creative commons"], f"creative commons attribution noncommercial share ?alike 4 0( international)?( public)?( {_LIC})?"),
    ("cc-by-nc-sa", 2, ["creative commons"], f"creative commons attribution non ?commercial share ?alike( [123] [05])?( {_LIC})?"),
    ("cc-by-nc-4.0", 1, ["creative commons"], f"creative commons attribution non ?commercial 4 0( international)?( public)?( {_LIC})?"),
    ("cc-by-nc", 2, ["creative commons"], f"creative commons attribution non ?commercial( [123] [05])?( {_LIC})?"),
    ("cc-by-nd", 2, ["creative commons"], f"creative commons attribution no ?deriv(ative)?s( [1234] [05])?( {_LIC})?"),
    ("cc-by-sa-4.0", 1, ["creative commons"], f"creative commons attribution share ?alike 4 0( international)?( public)?( {_LIC})?"),
    ("cc-by-sa-3.0", 1, ["creative commons"], f"creative commons attribution share ?alike 3 0( unported)?( {_LIC})?"),
    ("cc-by-sa", 2, ["creative commons"], f"creative commons attribution share ?alike( [12] [05])?( {_LIC})?"),
    ("cc-by-4.0", 1, ["creative commons"], f"creative commons attribution 4 0( international)?( public)?( {_LIC})?"),
    ("cc-by-3.0", 1, ["creative commons"], f"creative commons attribution 3 0( unported)?( {_LIC})?"),
    ("cc-by", 2, ["creative commons"], f"creative commons attribution( {_LIC})?"),
    ("cc0-1.0", 2, ["creative commons"], "creative commons (cc0|zero)( [^ ]+){0,3}"),
    ("cc-public-domain", 2, ["creative commons"], "creative commons public domain( mark| dedication)?( 1 0)?"),
    ("cc-by-nc-sa", 1, ["creativecommons org"], "creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", 1, ["creativecommons org"], "creativecommons org licenses by nc nd [1234] [05]"),
    ("cc-by-nc", 1, ["creativecommons org"], "creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nd", 1, ["creativecommons org"], "creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-sa", 1, ["creativecommons org"], "creativecommons org licenses by sa [1234] [05]"),
    ("cc-by", 1, ["creativecommons org"], "creativecommons org licenses by [1234] [05]"),
    ("cc0-1.0", 1, ["creativecommons org"], "creativecommons org publicdomain zero 1 0"),
    ("cc-public-domain", 1, ["creativecommons org"], "creativecommons org publicdomain mark 1 0"),
    ("creative-commons", 3, ["creative commons"], f"creative commons( {_LIC}| lizenz)?"),
    ("creative-commons", 3, ["licence creative commons", "licencia creative commons", "licenza creative commons"],
     "(licence|licencia|licenza) creative commons"),
    ("creative-commons", 4, ["some rights reserved"], "some rights reserved"),
    # data licenses
    ("odbl-1.0", 2, ["open database", "odbl"], f"(open database {_LIC}|odbl)( v| version)?( 1 0)?"),
    ("odc-by-1.0", 2, ["open data commons"], f"open data commons attribution {_LIC}( v| version)?( 1 0)?"),
    ("pddl-1.0", 2, ["public domain dedication and license"], "public domain dedication and license( 1 0)?"),
    ("ogl-3.0", 2, ["open government"], f"open government {_LIC}( v| version)? ?3( 0)?"),
    ("ogl", 3, ["open government"], f"open government {_LIC}"),
    ("etalab", 3, ["licence ouverte", "etalab"], "(licence ouverte|etalab)( open licence)?( [^ ]+ 2 0)?"),
    ("dl-de-by-2.0", 3, ["datenlizenz deutschland"], "datenlizenz deutschland( namensnennung| zero)?( version)?( 2 0)?"),
    ("cdla-permissive", 3, ["community data license"], "community data license agreement permissive"),
    ("cdla-sharing", 3, ["community data license"], "community data license agreement sharing"),
    # source-available and model licenses
    ("sspl-1.0", 2, ["server side public"], f"server side public {_LIC}( sspl)?( v| version)?( 1)?"),
    ("busl-1.1", 2, ["business source"], f"business source {_LIC}( v| version)?( 1 1)?"),
    ("elastic-2.0", 2, ["elastic license", "elastic licence"], f"elastic {_LIC}( v| version)?( 2( 0)?)?"),
    ("commons-clause", 2, ["commons clause"], "commons clause( license condition)?( v1 0)?"),
    ("polyform-nc", 2, ["polyform"], f"polyform noncommercial {_LIC}( 1 0 0)?"),
    ("polyform", 3, ["polyform"], f"polyform [^ ]+ {_LIC}"),
    ("prosperity", 3, ["prosperity public"], f"prosperity public {_LIC}"),
    ("parity", 3, ["parity public"], f"parity public {_LIC}"),
    ("openrail", 3, ["openrail", "open rail"], "(bigscience |bigcode |creativeml )?open ?rail( m)?( license)?"),
    ("llama", 3, ["community license agreement"], "llama( [^ ]+){0,2} community license agreement"),
    # public domain
    ("public-domain", 2, ["public domain"], "(placed|released|dedicated)( in| into| to) the public domain"),
    ("public-domain", 3, ["public domain"], "(is|are) in the public domain"),
    ("public-domain", 3, ["domaine public", "dominio público", "pubblico dominio", "gemeinfrei"],
     "(domaine public|dominio público|pubblico dominio|gemeinfrei)"),
    ("public-domain", 4, ["public domain"], "public domain"),
    # proprietary notices
    ("proprietary", 2, ["confidential"], "proprietary and confidential( information)?"),
    ("proprietary", 2, ["strictly prohibited"], "unauthorized (copying|use|distribution|reproduction)( [^ ]+){0,10} strictly prohibited"),
    ("proprietary", 2, ["without the prior written"],
     "(reproduced|copied|distributed|transmitted)( [^ ]+){0,25} without the prior written (permission|consent)"),
    ("proprietary", 3, ["end user license", "end user licence"], f"end user {_LIC} agreement"),
    ("proprietary", 3, ["trade secret", "trade secrets"], "contains trade secrets?"),
    ("proprietary", 4, ["do not distribute"], "do not distribute"),
    ("reserved", 2, ["rights reserved"], "copyright( c)?( [^ ]+){1,8} all rights reserved"),
    ("reserved", 3, ["rights are reserved"], "all rights are reserved"),
    ("reserved", 3, ["alle rechte vorbehalten"], "alle rechte vorbehalten"),
    ("reserved", 3, ["tous droits réservés"], "tous droits réservés"),
    ("reserved", 3, ["todos los derechos reservados"], "todos los derechos reservados"),
    ("reserved", 3, ["tutti i diritti riservati"], "tutti i diritti riservati"),
    ("copyright", 3, ["copyright"], "copyright( c)? (19|20)[0-9][0-9]"),
    ("copyright", 3, ["copyright by"], "copyright by"),
    ("copyright", 4, ["urheberrecht", "urheberrechtlich"], "urheberrecht(lich)?( geschützt)?"),
    # hints of some license
    ("permissive-hint", 4, ["free of charge"], "free of charge( for)?( any| all)?( purposes?)?"),
    ("no-warranty", 4, ["without warranties", "without warranty", "without any warranty"],
     "without (any )?warrant(y|ies)( or conditions)?( of any kind)?"),
    ("unknown-license", 4, ["license agreement", "licence agreement"], f"{_LIC} agreement"),
    ("unknown-license", 4, ["licensed under", "lizenziert unter"], "(licensed|lizenziert) (under|unter)( [^ ]+){1,3}"),
    ("unknown-license", 4, ["terms of the license", "terms of the licence"], f"terms of the {_LIC}"),
    ("unknown-license", 4, ["license file", "licence file", "license txt"], f"{_LIC} (file|txt)"),
    ("unknown-license", 4, ["open source license", "open source licence"], f"open source {_LIC}"),
]


def words(phrase: str) -> str:
    """A phrase as the scan normalises text: lower-case words with one space between them."""
    return " ".join("".join(c if c.isalnum() else " " for c in phrase.lower()).split())


def rules() -> list[tuple[str, int, list[str], str]]:
    """All rules in their order: base phrases, identifier tags, hand-written signatures."""
    out = [(label, 0, [phrase], phrase) for label, phrase in BASE]
    for name in SPDX:
        out.append((name.lower(), 1, ["spdx"], f"spdx license identifier {words(name)}"))
    return out + [(label, priority, gates, regex) for label, priority, gates, regex in SIGNATURES]
