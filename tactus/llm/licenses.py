"""License detection: ordered signature rules behind keywords, resolved by priority and containment.

Only DataFrame functions. Every rule is a regular expression with a keyword and more words that any
text it matches holds; the expression runs only on texts with all of them. A blank in a rule stands for one or more characters that are no word characters.
"""

from __future__ import annotations

import re
from functools import cache
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII characters that are no word characters once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: A text without any of these words and without "cc by" matches no rule and no phrase.
GATE = (
    "licen", "lizenz", "spdx", "copyright", "copyleft", "creative", "creativecommons", "cc0", "domain", "gemeinfrei", "apache",
    "mozilla", "general", "gpl", "gfdl", "bsd", "cddl", "cecill", "eupl", "odbl", "pddl", "sspl", "openrail", "gemma", "wtfpl",
    "permission", "redistribut", "contributors", "advertising", "warrant", "liable", "reserved", "vorbehalten", "réservés", "dominio",
    "reservados", "proprietary", "ouverte", "clause", "unencumbered", "attribution", "w3c", "unicode",
)
CC_BY = f"cc{GAP}+by"
#: Phrases with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
SCORE_OF_TIER = {1: 1.0, 2: 0.8, 3: 0.5}

# Tier 1 names one license and its version, tier 2 a license or family, tier 3 only hints.
# label ; keyword ; expression
TIER_1 = r"""
apache-1.0 ; apache ; apache (?:software )?license (?:version |v ?)?1 0
apache-1.1 ; apache ; apache (?:software )?license (?:version |v ?)?1 1
apache-2 ; apache ; apache (?:software )?license (?:version |v ?)?2(?: 0)?
apache-2 ; apache ; apache 2(?: 0)? license
apache-2 ; apache ; apache license 2(?: 0)?
apache-2 ; licenses ; www apache org licenses license 2 0
apache-2 ; apache ; spdx license identifier apache 2 0
mit ; spdx ; spdx license identifier mit
mit ; mit ; (?:the )?mit license
mit ; licensed ; licensed under (?:the )?(?:terms of (?:the )?)?mit
mit ; opensource ; opensource org licenses mit(?: license)?
mit ; permission ; permission is hereby granted free of charge to any person obtaining a copy of this software
mit ; substantial ; the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit-0 ; spdx ; spdx license identifier mit 0
x11 ; x11 ; x11 license
x11 ; spdx ; spdx license identifier x11
expat ; expat ; expat license
isc ; spdx ; spdx license identifier isc
isc ; isc ; (?:the )?isc license
isc ; distribute ; permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
0bsd ; 0bsd ; spdx license identifier 0bsd
0bsd ; license ; (?:bsd zero clause|zero clause bsd) license
bsd-1 ; bsd ; (?:bsd 1 clause|1 clause bsd)(?: license)?
bsd-2 ; bsd ; (?:bsd 2 clause|2 clause bsd)(?: license)?
bsd-2 ; simplified ; simplified bsd license
bsd-2 ; freebsd ; freebsd license
bsd-2 ; clause ; spdx license identifier bsd 2 clause
bsd-3 ; bsd ; (?:bsd 3 clause|3 clause bsd)(?: license)?
bsd-3 ; bsd ; (?:new|revised|modified) bsd license
bsd-3 ; clause ; spdx license identifier bsd 3 clause
bsd-3 ; contributors ; neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote
bsd-4 ; bsd ; (?:bsd 4 clause|4 clause bsd)(?: license)?
bsd-4 ; original ; original bsd license
bsd-4 ; advertising ; all advertising materials mentioning features or use of this software
gpl-1 ; general ; gnu general public license (?:version |v ?)1(?: 0)?
gpl-1 ; gpl ; gpl (?:version |v ?)?1(?: 0)?
gpl-2 ; general ; gnu general public license (?:version |v ?)2(?: 0)?
gpl-2 ; general ; version 2 of the gnu general public license
gpl-2 ; gpl ; (?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?
gpl-2 ; gplv2 ; gplv2
gpl-2 ; spdx ; spdx license identifier gpl 2 0(?: only)?
gpl-2+ ; general ; gnu general public license (?:version |v ?)2(?: 0)? or (?:at your option )?any later version
gpl-2+ ; option ; either version 2 of the license or at your option any later version
gpl-2+ ; later ; spdx license identifier gpl 2 0 or later
gpl-3 ; general ; gnu general public license (?:version |v ?)3(?: 0)?
gpl-3 ; general ; version 3 of the gnu general public license
gpl-3 ; gpl ; (?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?
gpl-3 ; gplv3 ; gplv3
gpl-3 ; spdx ; spdx license identifier gpl 3 0(?: only)?
gpl-3+ ; general ; gnu general public license (?:version |v ?)3(?: 0)? or (?:at your option )?any later version
gpl-3+ ; option ; either version 3 of the license or at your option any later version
gpl-3+ ; later ; spdx license identifier gpl 3 0 or later
lgpl-2 ; general ; gnu library general public license (?:version |v ?)2(?: 0)?
lgpl-2.1 ; general ; gnu lesser general public license (?:version |v ?)2 1
lgpl-2.1 ; lgpl ; lgpl ?(?:version |v ?)?2 1
lgpl-2.1 ; lgpl ; spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3 ; general ; gnu lesser general public license (?:version |v ?)3(?: 0)?
lgpl-3 ; lgpl ; lgpl ?(?:version |v ?)?3(?: 0)?
lgpl-3 ; lgpl ; spdx license identifier lgpl 3 0(?: only| or later)?
agpl-1 ; general ; affero general public license (?:version |v ?)1(?: 0)?
agpl-3 ; general ; (?:gnu )?affero general public license (?:version |v ?)3(?: 0)?
agpl-3 ; agpl ; agpl ?(?:version |v ?)?3(?: 0)?
agpl-3 ; agpl ; spdx license identifier agpl 3 0(?: only| or later)?
gfdl-1.1 ; documentation ; gnu free documentation license (?:version |v ?)1 1
gfdl-1.2 ; documentation ; gnu free documentation license (?:version |v ?)1 2
gfdl-1.3 ; documentation ; gnu free documentation license (?:version |v ?)1 3
mpl-1.0 ; mozilla ; mozilla public license (?:version |v ?)?1 0
mpl-1.1 ; mozilla ; mozilla public license (?:version |v ?)?1 1
mpl-1.1 ; spdx ; spdx license identifier mpl 1 1
mpl-2 ; mozilla ; mozilla public license (?:version |v ?)?2(?: 0)?
mpl-2 ; spdx ; spdx license identifier mpl 2 0
mpl-2 ; mozilla ; mozilla org mpl 2 0
epl-1 ; eclipse ; eclipse public license (?:version |v ?)?1(?: 0)?
epl-2 ; eclipse ; eclipse public license (?:version |v ?)?2(?: 0)?
epl-2 ; spdx ; spdx license identifier epl 2 0
edl-1 ; distribution ; eclipse distribution license (?:version |v ?)?1(?: 0)?
cddl-1 ; distribution ; common development and distribution license (?:version |v ?)?1 0
cddl-1.1 ; distribution ; common development and distribution license (?:version |v ?)?1 1
cddl-1 ; cddl ; cddl 1 0
cpl-1 ; common ; common public license (?:version |v ?)?1 0
ipl-1 ; ibm ; ibm public license (?:version |v ?)?1 0
eupl-1.1 ; european ; european union public licen[cs]e (?:version |v ?)?1 1
eupl-1.2 ; european ; european union public licen[cs]e (?:version |v ?)?1 2
eupl-1.2 ; eupl ; eupl 1 2
artistic-1 ; artistic ; artistic license (?:version |v ?)?1(?: 0)?
artistic-2 ; artistic ; artistic license (?:version |v ?)?2(?: 0)?
boost-1 ; boost ; boost software license (?:version |v ?)?1(?: 0)?
business-source-1.1 ; business ; business source license (?:version |v ?)?1 1
sspl-1 ; server ; server side public license (?:version |v ?)?1
elastic-2 ; elastic ; elastic license (?:version |v ?)?2(?: 0)?
python-2 ; foundation ; python software foundation license (?:version |v ?)?2
php-3.0 ; php ; php license (?:version |v ?)?3 0
php-3.01 ; php ; php license (?:version |v ?)?3 01
zpl-2.1 ; zope ; zope public license (?:version |v ?)?2 1
osl-3 ; open ; open software license (?:version |v ?)?3(?: 0)?
afl-3 ; academic ; academic free license (?:version |v ?)?3(?: 0)?
cecill-2.1 ; cecill ; cecill (?:version |v ?)?2 1
ofl-1.1 ; font ; (?:sil )?open font license (?:version |v ?)?1 1
lppl-1.3 ; project ; latex project public license (?:version |v ?)?1 3c?
ms-pl ; microsoft ; microsoft public license
ms-rl ; reciprocal ; microsoft reciprocal license
apsl-2 ; source ; apple public source license (?:version |v ?)?2(?: 0)?
upl-1 ; permissive ; universal permissive license (?:version |v ?)?1(?: 0)?
mulan-2 ; mulan ; mulan permissive software license (?:version |v ?)?2
odbl-1 ; database ; open database license (?:version |v ?)?1(?: 0)?
odc-by-1 ; attribution ; open data commons attribution license (?:version |v ?)?1(?: 0)?
pddl-1 ; dedication ; public domain dedication and license (?:version |v ?)?1(?: 0)?
cdla-permissive-2 ; permissive ; community data license agreement permissive (?:version |v ?)?2(?: 0)?
cdla-sharing-1 ; agreement ; community data license agreement sharing (?:version |v ?)?1(?: 0)?
openrail-m ; openrail ; (?:creativeml )?openrail m
llama-community ; community ; llama [0-9](?: [0-9])? community license
cc0-1.0 ; cc0 ; cc0(?: 1 0)?(?: universal)?
cc0-1.0 ; creativecommons ; creativecommons org publicdomain zero 1 0
cc0-1.0 ; dedication ; cc0 1 0 universal public domain dedication
cc-pdm ; creativecommons ; creativecommons org publicdomain mark 1 0
cc-by-1.0 ; by ; cc by 1 0
cc-by-2.0 ; by ; cc by 2 0
cc-by-2.5 ; by ; cc by 2 5
cc-by-3.0 ; by ; cc by 3 0
cc-by-4.0 ; by ; cc by 4 0
cc-by-4.0 ; attribution ; creative commons attribution 4 0(?: international)?
cc-by-4.0 ; creativecommons ; creativecommons org licenses by 4 0
cc-by-sa-2.0 ; sa ; cc by sa 2 0
cc-by-sa-2.5 ; sa ; cc by sa 2 5
cc-by-sa-3.0 ; sa ; cc by sa 3 0
cc-by-sa-4.0 ; sa ; cc by sa 4 0
cc-by-sa-3.0 ; attribution ; creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa-4.0 ; attribution ; creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-4.0 ; creativecommons ; creativecommons org licenses by sa 4 0
cc-by-nd-2.0 ; nd ; cc by nd 2 0
cc-by-nd-3.0 ; nd ; cc by nd 3 0
cc-by-nd-4.0 ; nd ; cc by nd 4 0
cc-by-nd-4.0 ; attribution ; creative commons attribution no ?derivatives 4 0(?: international)?
cc-by-nc-2.0 ; nc ; cc by nc 2 0
cc-by-nc-3.0 ; nc ; cc by nc 3 0
cc-by-nc-4.0 ; nc ; cc by nc 4 0
cc-by-nc-4.0 ; attribution ; creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc-4.0 ; creativecommons ; creativecommons org licenses by nc 4 0
cc-by-nc-sa-2.0 ; sa ; cc by nc sa 2 0
cc-by-nc-sa-3.0 ; sa ; cc by nc sa 3 0
cc-by-nc-sa-4.0 ; sa ; cc by nc sa 4 0
cc-by-nc-sa-4.0 ; attribution ; creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-nd-3.0 ; nd ; cc by nc nd 3 0
cc-by-nc-nd-4.0 ; nd ; cc by nc nd 4 0
cc-by-nc-nd-4.0 ; attribution ; creative commons attribution non ?commercial no ?derivatives 4 0(?: international)?
"""

TIER_2 = r"""
apache ; apache ; apache (?:software )?license
apache ; apache ; apache licensed
bsd ; licen ; bsd(?: style)? licen[cs]ed?
bsd ; redistribution ; redistribution and use in source and binary forms with or without modification are permitted
gpl ; general ; (?:gnu )?general public licen[cs]e
gpl ; gpl ; gnu gpl
gpl ; licen ; gpl licen[cs]ed?
gpl ; gpl ; under the gpl
lgpl ; general ; (?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl ; lgpl ; lgpl
agpl ; general ; affero general public licen[cs]e
agpl ; agpl ; agpl
gfdl ; documentation ; (?:gnu )?free documentation licen[cs]e
gfdl ; gfdl ; gfdl
mpl ; mozilla ; mozilla public licen[cs]e
epl ; eclipse ; eclipse public licen[cs]e
cddl ; distribution ; common development and distribution license
cddl ; cddl ; cddl
cpl ; common ; common public license
eupl ; european ; european union public licen[cs]e
artistic ; artistic ; artistic license
clarified-artistic ; clarified ; clarified artistic license
boost ; boost ; boost software license
business-source ; business ; business source license
sspl ; server ; server side public license
sspl ; sspl ; sspl
elastic ; elastic ; elastic license
commons-clause ; commons ; commons clause
python ; foundation ; python software foundation license
php ; php ; php license
zlib ; zlib ; zlib(?: libpng)? license
libpng ; libpng ; libpng license
openssl ; openssl ; openssl license
curl ; curl ; curl license
postgresql ; postgresql ; postgresql licen[cs]e
vim ; vim ; vim license
wtfpl ; wtfpl ; wtfpl
wtfpl ; want ; do what the fuck you want to public license
beerware ; beer ; beer ?ware license
unlicense ; unlicense ; (?:the )?unlicense
unlicense ; unencumbered ; this is free and unencumbered software released into the public domain
ncsa ; university ; university of illinois (?:ncsa )?open source license
zope ; zope ; zope public license
osl ; open ; open software license
afl ; academic ; academic free license
cecill ; cecill ; cecill(?: b| c)?
ofl ; font ; (?:sil )?open font license
lppl ; project ; latex project public license
apsl ; source ; apple public source license
qpl ; license ; q public license
sleepycat ; sleepycat ; sleepycat license
w3c ; w3c ; w3c software(?: notice and)? license
hippocratic ; hippocratic ; hippocratic license
ssh ; short ; ssh short license
unicode ; unicode ; unicode (?:terms of use|license agreement)
odbl ; database ; open database license
odbl ; odbl ; odbl
pddl ; pddl ; pddl
cdla ; agreement ; community data license agreement
gemma ; terms ; gemma terms of use
cc0 ; cc0 ; cc0
cc0 ; creative ; creative commons zero
cc-by ; by ; cc by
cc-by ; attribution ; creative commons attribution(?: licen[cs]e)?
cc-by-sa ; sa ; cc by sa
cc-by-sa ; attribution ; creative commons attribution share ?alike(?: licen[cs]e)?
cc-by-nd ; nd ; cc by nd
cc-by-nd ; attribution ; creative commons attribution no ?derivatives(?: licen[cs]e)?
cc-by-nc ; nc ; cc by nc
cc-by-nc ; attribution ; creative commons attribution non ?commercial(?: licen[cs]e)?
cc-by-nc-sa ; sa ; cc by nc sa
cc-by-nc-sa ; attribution ; creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?
cc-by-nc-nd ; nd ; cc by nc nd
cc-by-nc-nd ; attribution ; creative commons attribution non ?commercial no ?derivatives(?: licen[cs]e)?
creative-commons ; creative ; (?:a )?creative commons licen[cs]e
creative-commons ; creativecommons ; creativecommons org licenses
creative-commons ; creative ; licence creative commons
creative-commons ; creative ; creative commons lizenz
creative-commons ; creative ; licencia (?:de )?creative commons
public-domain ; domain ; (?:released (?:in ?to|in) |in |dedicated to )the public domain
public-domain ; dedication ; public domain dedication
public-domain ; domaine ; domaine public
public-domain ; gemeinfrei ; gemeinfrei(?:e|es|en)?
public-domain ; dominio ; dominio público
open-government ; government ; open government licen[cs]e
etalab ; ouverte ; licence ouverte
dl-de-by ; deutschland ; datenlizenz deutschland(?: namensnennung)?
proprietary ; proprietary ; proprietary and confidential
proprietary ; proprietary ; proprietary licen[cs]e
"""

TIER_3 = r"""
all-rights-reserved ; reserved ; all rights reserved
all-rights-reserved ; réservés ; tous droits réservés
all-rights-reserved ; vorbehalten ; alle rechte vorbehalten
all-rights-reserved ; reservados ; todos los derechos reservados
copyright ; copyright ; copyright (?:c )?(?:19|20)[0-9]{2}
copyright ; copyright ; copyright notice
copyright ; copyright ; copyright (?:by|holders?|owners?)
copyleft ; copyleft ; copyleft
disclaimer ; warrant ; without warrant(?:y|ies) of any kind
disclaimer ; warranty ; without any warranty
disclaimer ; liable ; in no event shall .{1,60}? be liable
notice ; licensed ; (?:dual )?licensed under
notice ; released ; released under (?:[a-z0-9]+ ){0,5}licen[cs]e
notice ; distributed ; distributed under (?:[a-z0-9]+ ){0,5}licen[cs]e
notice ; terms ; under the terms of (?:[a-z0-9]+ ){0,5}licen[cs]e
notice ; licen ; see (?:the )?licen[cs]e(?: file)?
notice ; license ; license (?:file|text|agreement)
notice ; agreement ; end user license agreement
notice ; spdx ; spdx license identifier
notice ; licence ; sous licence
notice ; lizenz ; unter der lizenz
notice ; licencia ; bajo (?:la )?licencia
"""


def _expression(rule: str) -> str:
    """A blank becomes the gap between words, ``blank + ?`` an optional gap; whole words only."""
    body = rule.strip().replace(" ?", f"{GAP}*").replace(" ", f"{GAP}+")
    return f"(?<!{WORD})(?:{body})(?!{WORD})"


def required(rule: str) -> list[str]:
    """Letters that every match of a rule holds: the beginnings of its words outside brackets."""
    flat, before = rule.strip(), ""
    while flat != before:  # innermost brackets first; the letters beside one are words of their own
        before = flat
        flat = re.sub(r"\([^()]*\)[?]?", " ", flat)
    words = [re.match(r"[^\W_]*", w)[0] + "\x00" + w[len(re.match(r"[^\W_]*", w)[0]) :][:1] for w in flat.split()]
    words = [w[:-3] if w.endswith("\x00?") else w.split("\x00")[0] for w in words if not w.endswith("\x00{")]
    return sorted({w for w in words if len(w) > 1}, key=lambda w: (-len(w), w))


@cache
def rules() -> tuple[tuple[int, int, str, tuple[str, ...], str], ...]:
    """(tier, order, label, keywords, expression), most trusted first."""
    out = []
    for tier, text in ((1, TIER_1), (2, TIER_2), (3, TIER_3)):
        for line in text.strip().splitlines():
            label, keyword, rule = (x.strip() for x in line.split(";"))
            words = tuple(dict.fromkeys([keyword, *required(rule)]))
            out.append((tier, len(out), label, words, _expression(rule)))
    return tuple(out)


def _count(text: Column) -> Column:
    """Words of a lower-cased text."""
    return F.size(F.array_remove(F.split(text, f"{GAP}+", -1), "")).cast("long")


def _places(text: Column, expression: Column | str) -> Column:
    """array<struct<start, end>> in characters from 0 of every match; no match is empty."""
    expression = F.lit(expression) if isinstance(expression, str) else expression
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["hit"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found"))

    def found(both: Column) -> Column:
        pieces = F.slice(both["pieces"], 1, F.size(both["hits"]))
        pairs = F.zip_with(pieces, both["hits"], lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
        return F.aggregate(pairs, start, step, lambda acc: acc["found"])

    # One element, so that both arrays are made once and then used by name.
    parts = F.struct(F.split(text, expression, -1).alias("pieces"), F.regexp_extract_all(text, expression, F.lit(0)).alias("hits"))
    return F.transform(F.array(parts), found)[0]


def licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Phrases and license labels of each row.

    Texts are lower-cased in A-Z only. ``n_base`` counts all places of the base phrases;
    ``first_word`` and ``last_word`` are the word numbers of the first and last of them. ``labels``
    holds the base labels and those of the rules that remain: a detection goes if it lies inside
    another one of the same or a more trusted tier (of equal intervals in one tier, the first rule
    stays). ``score`` is 1.0, 0.8 or 0.5 for the most trusted tier found, 1.0 with a base phrase.

    Each row is judged by itself with no shuffle: repeated rows and null ids stay, other columns are
    not looked at. A null or empty text has no words, empty label strings and score 0.0. An empty
    table gives an empty result.
    """
    low = F.translate(F.coalesce(docs[text_column], F.lit("")), ascii_uppercase, ascii_lowercase)
    df = docs.select(docs[id_column].alias(id_column), low.alias("__all"))
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.contains("__all", F.lit(word))
    gate = gate | F.rlike("__all", F.lit(CC_BY))
    df = df.select(id_column, _count(F.col("__all")).alias("n_words"), F.when(gate, F.col("__all")).otherwise(F.lit("")).alias("__low"))
    none = F.array().cast("array<int>")
    phrase_places = [
        F.when(F.rlike("__low", F.lit(_expression(p))), F.transform(_places(F.col("__low"), _expression(p)), lambda x: x["start"])).otherwise(none)
        for p, _ in PHRASES
    ]
    table = F.array(
        *[
            F.struct(F.lit(t).alias("tier"), F.lit(n).alias("order"), F.lit(a).alias("label"), F.array(*map(F.lit, k)).alias("keywords"), F.lit(e).alias("expression"))
            for t, n, a, k, e in rules()
        ]
    )
    fit = F.filter(table, lambda r: F.forall(r["keywords"], lambda k: F.contains(F.col("__low"), k)) & F.rlike(F.col("__low"), r["expression"]))
    found = F.flatten(
        F.transform(
            fit,
            lambda r: F.transform(
                _places(F.col("__low"), r["expression"]),
                lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("neg_end"), r["tier"].alias("tier"), r["order"].alias("order"), r["label"].alias("label")),
            ),
        )
    )
    some = F.col("__low") != ""
    nothing = F.array().cast("array<struct<start:int,neg_end:int,tier:int,order:int,label:string>>")
    df = df.select(
        id_column,
        "n_words",
        "__low",
        *[p.alias(f"__p{i}") for i, p in enumerate(phrase_places)],
        F.when(some, F.array_sort(found)).otherwise(nothing).alias("__found"),
    )

    def keep(acc: Column, d: Column) -> Column:
        end, tier = -d["neg_end"], d["tier"]
        inside = F.greatest(acc["e1"], F.when(tier >= 2, acc["e2"]).otherwise(-1), F.when(tier >= 3, acc["e3"]).otherwise(-1)) >= end
        return F.struct(
            *[F.when(tier == k, F.greatest(acc[f"e{k}"], end)).otherwise(acc[f"e{k}"]).alias(f"e{k}") for k in (1, 2, 3)],
            F.when(inside, acc["best"]).otherwise(F.least(acc["best"], tier)).alias("best"),
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
        )

    start = F.struct(
        F.lit(-1).alias("e1"), F.lit(-1).alias("e2"), F.lit(-1).alias("e3"), F.lit(9).alias("best"), F.array().cast("array<string>").alias("labels")
    )
    starts = F.concat(*[f"__p{i}" for i in range(len(PHRASES))])
    own = F.array_compact(F.array(*[F.when(F.size(f"__p{i}") > 0, label) for i, (_, label) in enumerate(PHRASES)]))
    df = df.select(
        id_column,
        "n_words",
        "__low",
        starts.alias("__starts"),
        F.array_sort(F.array_distinct(own)).alias("__own"),
        F.aggregate("__found", start, keep).alias("__kept"),
    )
    before = lambda at: _count(F.substring(F.col("__low"), F.lit(1), at))
    scored = F.col("__kept")["best"]
    score = F.when(F.size("__own") > 0, 1.0)
    for tier, value in SCORE_OF_TIER.items():
        score = score.when(scored == tier, value)
    return df.select(
        id_column,
        "n_words",
        F.size("__starts").cast("long").alias("n_base"),
        F.when(F.size("__starts") > 0, before(F.array_min("__starts"))).alias("first_word"),
        F.when(F.size("__starts") > 0, before(F.array_max("__starts"))).alias("last_word"),
        F.array_join("__own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__own", F.col("__kept")["labels"])), ",").alias("labels"),
        score.otherwise(0.0).alias("score"),
    )
