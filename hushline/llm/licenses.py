"""License scans: ordered signature rules with a keyword gate, in DataFrame functions only.

Rules are regular expressions over a text's words (lower case, joined by single spaces), some
hundreds in all. SIGNATURES are written one by one: sentences of license texts and notices. The
rest come from a table of licenses and a few forms in which people name them, as a list of that
length is better given by a rule. A rule is tried only on texts that hold its keyword; texts without
any trigger meet no rule. Every hit is a span of words. A span within another is suppressed if the
other has higher priority, or the same and is longer or its rule comes first: spans go by start and
falling end, and a running maximum of the ends seen, for each priority, tells what lies within.
Base phrases outrank all and are never suppressed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: License families: label, keyword (a word of every match of the name), name as a regex over words, versions (None: unversioned).
FAMILIES = (
    ("mit", "mit", "mit", (None,)),
    ("mit", "expat", "expat", (None,)),
    ("apache", "apache", "apache(?: software)?", (None, "1 0", "1 1", "2", "2 0")),
    ("gpl", "general", "(?:gnu )?general public", (None, "1", "2", "2 0", "3", "3 0")),
    ("gpl", "gpl", "(?:gnu )?gpl", (None, "2", "2 0", "3", "3 0")),
    ("lgpl", "lesser", "(?:gnu )?lesser general public", (None, "2 1", "3", "3 0")),
    ("agpl", "affero", "(?:gnu )?affero general public", (None, "1", "3", "3 0")),
    ("mpl", "mozilla", "mozilla public", (None, "1 0", "1 1", "2 0")),
    ("bsd", "bsd", "(?:(?:new|modified|simplified) )?bsd(?: [234] clause)?", (None,)),
    ("isc", "isc", "isc", (None,)),
    ("epl", "eclipse", "eclipse public", (None, "1 0", "2 0")),
    ("cddl", "cddl", "cddl", (None, "1 0", "1 1")),
    ("artistic", "artistic", "artistic", (None, "1 0", "2 0")),
    ("zlib", "zlib", "zlib(?: libpng)?", (None,)),
    ("bsl", "boost", "boost software", (None, "1 0")),
    ("unlicense", "unlicense", "unlicense", (None,)),
    ("wtfpl", "wtfpl", "wtfpl", (None, "2")),
    ("ofl", "sil", "sil open font", (None, "1 0", "1 1")),
    ("eupl", "european", "european union public", (None, "1 1", "1 2")),
    ("postgresql", "postgresql", "postgresql", (None,)),
    ("psf", "python", "python software foundation", (None, "2")),
    ("odbl", "database", "open database", (None, "1 0")),
    ("ms-pl", "microsoft", "microsoft public", (None,)),
    ("upl", "universal", "universal permissive", (None, "1 0")),
    ("cc-by", "creative", "creative commons(?: attribution| by)", (None, "2 0", "3 0", "4 0")),
    ("cc-by", "cc", "cc(?: attribution| by)", (None, "2 0", "3 0", "4 0")),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike", (None, "3 0", "4 0")),
    ("cc-by-sa", "sa", "cc by sa", (None, "3 0", "4 0")),
    ("cc-by-nc", "nc", "cc by nc", (None, "3 0", "4 0")),
    ("cc-by-nc-sa", "sa", "cc by nc sa", (None, "3 0", "4 0")),
    ("cc-by-nc-nd", "nd", "cc by nc nd", (None, "3 0", "4 0")),
    ("cc0", "cc0", "cc0", (None, "1 0")),
)

#: Signatures: label, keyword (a word of every match), regex over words. Sentences that the license's text or its notice holds.
SIGNATURES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "sublicense", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-0", "furnished", "to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", "hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc", "tortious", "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "(?:neither the name of|the names? of) .{1,200}? (?:nor the names of its contributors )?may (?:not )?be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licenses", "you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0"),
    ("apache-2", "basis", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "governing", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2", "either", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "either", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "published", "gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl-3", "published", "gnu general public license version 3 (?:only )?as published by the free software foundation"),
    ("gpl", "merchantability", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "received", "you should have received a copy of the gnu general public license along with this (?:program|software|file|library|package)"),
    ("gpl", "temple", "free software foundation inc 59 temple place suite 330 boston ma"),
    ("gpl", "franklin", "free software foundation inc 51 franklin (?:st|street) fifth floor boston ma"),
    ("gpl-3", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-classpath", "linking", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-gcc-exception", "runtime", "gcc runtime library exception"),
    ("gpl-bison-exception", "bison", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-autoconf-exception", "autoconf", "this configuration script generated by autoconf"),
    ("lgpl", "lesser", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "library", "under the terms of the gnu library general public license as published by the free software foundation"),
    ("lgpl-2.1", "lesser", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3", "lesser", "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program|software)"),
    ("agpl", "affero", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl-3", "network", "offering? (?:all users interacting with it|users) remotely through a computer network"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("fsfap", "medium", "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("npl", "netscape", "the contents of this file are subject to the netscape public license"),
    ("cddl", "distribution", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "distribution", "you may only use this file in accordance with the terms of the common development and distribution license"),
    ("epl-1", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("edl-1", "eclipse", "made available under the terms of the eclipse distribution license v ?1 0"),
    ("cpl-1", "common", "this program is made available under the terms of the common public license v ?1 0"),
    ("ipl-1", "ibm", "the accompanying program is provided under the terms of this ibm public license"),
    ("artistic", "perl", "this library is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("artistic", "perl", "you may distribute under the terms of either the gnu general public license or the artistic license as specified in the perl"),
    ("artistic-2", "package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "freely", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("libpng", "misrepresented", "the origin of this source code must not be misrepresented altered versions must be plainly marked"),
    ("bsl-1", "boost", "distributed under the boost software license version 1 0"),
    ("bsl-1", "boost", "boost software license version 1 0 august 17th 2003"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "detriment", "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("wtfpl", "fuck", "this program is free software it comes without any warranty .{0,120}do what the fuck you want to public license"),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", "reserved", "no modified version of the font software may use the reserved font name"),
    ("eupl", "eupl", "licensed under the eupl(?: version 1 [12])?"),
    ("postgresql", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("psf-2", "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce"),
    ("python-cnri", "cnri", "cnri open source license agreement"),
    ("ruby", "ruby", "ruby is copyrighted free software by yukihiro matsumoto"),
    ("php-3", "php", "this source file is subject to version 3 (?:0|01) of the php license"),
    ("php-3", "freely", "this product includes php software freely available from"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", "this product includes cryptographic software written by eric young"),
    ("x11", "consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("hpnd", "supporting", "that both that copyright notice and this permission notice appear in supporting documentation"),
    ("ncsa", "contributors", "neither the names of .{1,200}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("icu", "appear", "provided that the above copyright notice s and this permission notice appear in all copies of the software"),
    ("unicode", "unicode", "unicode inc license agreement data files and software"),
    ("w3c", "w3c", "this work is distributed under the w3c software (?:notice and )?license"),
    ("w3c", "w3c", "w3c software notice and license"),
    ("cc0-1", "waived", "to the extent possible under law .{1,200}? has waived all copyright and related or neighboring rights"),
    ("cc0-1", "dedicated", "(?:has|have) dedicated (?:the|this) work to the public domain"),
    ("cc-by-4", "creative", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-3", "creative", "this work is licensed under a creative commons attribution 3 0 unported license"),
    ("cc-by-sa-4", "sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa-3", "sharealike", "this work is licensed under a creative commons attribution sharealike 3 0 unported license"),
    ("cc-by-nc-4", "noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-sa-4", "noncommercial", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd-4", "noderivatives", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nd-4", "noderivatives", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-sa-3", "wikipedia", "text is available under the creative commons attribution share ?alike license (?:.{0,80} )?wikipedia"),
    ("odbl-1", "database", "this .{1,80}? is made available under the open database license"),
    ("odc-by-1", "commons", "open data commons attribution license"),
    ("pddl-1", "commons", "open data commons public domain dedication and license"),
    ("ms-pl", "microsoft", "this license governs use of the accompanying software if you use the software you accept this license microsoft public license"),
    ("ms-rl", "reciprocal", "microsoft reciprocal license ms rl"),
    ("upl-1", "universal", "the universal permissive license upl version 1 0"),
    ("afl-3", "academic", "licensed under the academic free license version 3 0"),
    ("osl-3", "open", "licensed under the open software license version 3 0"),
    ("cecill-2", "cecill", "this software is governed by the cecill(?: [bc])? license under french law"),
    ("mulan-2", "mulan", "licensed under mulan psl v2"),
    ("bsl-1.1", "business", "business source license 1 1"),
    ("sspl-1", "server", "server side public license(?: version 1)?"),
    ("elastic-2", "elastic", "licensed under the elastic license 2 0"),
    ("commons-clause", "clause", "commons clause license condition v1 0"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter) license 1 0 0"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("jquery", "dual", "dual licensed under the mit or gpl version 2 licenses"),
    ("public-domain", "domain", "(?:released|placed|dedicated|donated) (?:in|into|to) the public domain"),
    ("public-domain", "domain", "this (?:file|work|code|software|program) is (?:hereby )?(?:in|placed in) the public domain"),
    ("all-rights-reserved", "reserved", "all rights reserved (?:no part of this (?:publication|book|document|work)|reproduction|unauthorized)"),
    ("proprietary", "confidential", "this (?:software|file|document) (?:is|contains) (?:the )?(?:confidential and proprietary|proprietary and confidential) information"),
    ("proprietary", "medium", "unauthorized (?:copying|reproduction|distribution) of this (?:file|software|document) via any medium is strictly (?:forbidden|prohibited)"),
)

#: Forms: a name, priority, weight, the regex with {name} and {version}.
FORMS = (
    ("identifier", 5, 1.0, "spdx license identifier {name}{version}"),
    ("notice", 4, 0.9, "(?:re ?)?(?:dual |triple )?(?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?{name}(?: license| licence)?{version}"),
    ("title", 3, 0.7, "{name} licen[sc]e{version}"),
    ("adjective", 2, 0.6, "{name}{version} licensed"),
    ("reference", 1, 0.4, "(?:see|per|under) (?:the )?{name}{version} licen[sc]e"),
)
#: A text that holds none of these meets no rule; every match of a rule but those of the form `notice` and CC names holds one.
TRIGGERS = ("licen", "spdx", "software", "permi", "redistribut", "public domain", "copyright", "warrant", "linking", "exception", "generated by", "remotely", "invariant", "distributed", "misrepresented", "detriment", "what the", "if we meet", "x consortium", "rights reserved", "proprietary", "unauthorized")
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """(keyword, rule, regex, label, priority, weight) in rule order; base rules first."""
    out = [(phrase.split()[-1] if phrase.startswith("cc") else phrase.split()[phrase.split().index("license") - 1], f"base {label}", phrase, label, 9, 1.0) for phrase, label in BASE]
    for label, keyword, name, versions in FAMILIES:
        for version in versions:
            tag = label if version is None else f"{label}-{version.removesuffix(' 0').replace(' ', '.')}"
            number = "" if version is None else f"(?: (?:version|v))? {version}"
            for form, priority, weight, regex in FORMS:
                out.append((keyword, f"{form} {tag} {keyword} {version or ''}".strip(), regex.format(name=name, version=number), tag, priority, weight))
    out += [(keyword, f"text {label} {k}", regex, label, 6, 0.95) for k, (label, keyword, regex) in enumerate(SIGNATURES)]
    return out


def rule_table(spark: SparkSession) -> DataFrame:
    """Some hundreds of rows, fixed by FAMILIES and FORMS whatever the input."""
    names = ("keyword", "rank", "rule", "regex", "label", "priority", "weight")
    rows = [dict(zip(names, (k, i, name, f"(?<= )(?:{rx})(?= )", label, p, w), strict=True)) for i, (k, name, rx, label, p, w) in enumerate(rules())]
    shape = "array<struct<keyword:string,rank:int,rule:string,regex:string,label:string,priority:int,weight:double>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), shape)).alias("r")).select("r.*")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, _hash, start, end, label, priority, weight, base) of every hit that isn't suppressed.

    start counts words from 0, end is exclusive. Rows with equal doc_id and text share their spans.
    """
    keywords = sorted({r[0] for r in rules()})

    def any_trigger(low: F.Column) -> F.Column:
        held = F.lit(False)
        for t in TRIGGERS:
            held = held | low.contains(t)
        noticed = low.contains("under") & low.rlike("(?:licensed|released|distributed|published|available|provided)[^0-9a-z]+under")
        return held | noticed | (low.contains("cc") & low.rlike(r"(?<![0-9a-z])cc[^0-9a-z]+by(?![0-9a-z])"))

    triggered = F.exists(F.array(F.lower("_text")), any_trigger)  # the text is lower-cased once, not for each trigger
    own = docs.select("doc_id", text_of().alias("_text")).where(triggered).withColumn("_hash", F.xxhash64("_text"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    own = own.select("doc_id", "_hash", F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.translate("_text", upper, upper.lower()), NOT_WORD), lambda w: w != ""), " "), F.lit(" ")).alias("_line"))
    held = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.col("_line").contains(F.concat(F.lit(" "), k, F.lit(" "))))
    tried = own.select("doc_id", "_hash", "_line", F.explode(held).alias("keyword")).join(F.broadcast(rule_table(docs.sparkSession)), "keyword").where(F.rlike("_line", F.col("regex")))
    marked = F.split(F.regexp_replace("_line", F.col("regex"), F.lit("\x01$0\x02")), " ")
    tried = tried.select("doc_id", "_hash", "rank", "label", "priority", "weight", marked.alias("_words"))
    starts = F.expr("filter(transform(_words, (w, i) -> if(startswith(w, '\x01'), i - 1, null)), x -> x IS NOT NULL)")
    ends = F.expr("filter(transform(_words, (w, i) -> if(endswith(w, '\x02'), i, null)), x -> x IS NOT NULL)")
    hits = tried.select("doc_id", "_hash", "rank", "label", "priority", "weight", F.explode(F.arrays_zip(starts.alias("start"), ends.alias("end"))).alias("x"))
    hits = hits.select("doc_id", "_hash", F.struct("x.start", "x.end", "priority", "rank", "label", "weight").alias("s"))
    hits = hits.distinct()  # rows that repeat a doc_id and text give the same spans
    before = Window.partitionBy("doc_id", "_hash").orderBy("s.start", F.desc("s.end"), F.desc("s.priority"), "s.rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r[4] for r in rules()})
    reached = F.array(*[F.max(F.when(F.col("s.priority") >= level, F.col("s.end"))).over(before) for level in levels])
    ahead = hits.select("doc_id", "_hash", "s", F.element_at(reached, F.array_position(F.array(*map(F.lit, levels)), F.col("s.priority")).cast("int")).alias("reach"))
    kept = ahead.where((F.col("s.priority") == 9) | F.col("reach").isNull() | (F.col("reach") < F.col("s.end")))
    return kept.select("doc_id", "_hash", "s.start", "s.end", "s.label", "s.priority", "s.weight", (F.col("s.priority") == 9).alias("base"))


def license_scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> one row per row: n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels (empty strings) and score 0. The score is the
    weight of the strongest kept span. Rows that repeat a doc_id, null or not, count each by its own
    text. A very long text is one row in one task; its spans are sorted, never compared pair by pair.
    Other columns are ignored, whatever their names. An empty table gives an empty table.
    """
    found = spans(docs).groupBy("doc_id", "_hash").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("weight").alias("score"),
    )
    parts = F.split("_text", NOT_WORD)
    n = F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    own = docs.select("doc_id", text_of().alias("_text")).select("doc_id", F.xxhash64("_text").alias("_hash"), n.cast("long").alias("n_words"))
    both = own.join(found.withColumnRenamed("doc_id", "_id").withColumnRenamed("_hash", "_h"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    return both.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
