"""License scans, native: a positional index of rare tokens.

Templates are notices, headers and whole licences, as word sequences. For each, the index holds the places of the RARE words of its mandatory key phrase that have the
highest inverse document frequency over all files of the table. A file looks up its licence words there; every occurrence
votes for the place at which a template would begin. Where all words of a template agree, its key phrase is verified at its
place, and so is the share of the whole template. As the voting words are part of the key phrase, no verified place is lost.
Plain phrases are found beside that, wherever their words stand consecutively. Everything is one projection over arrays of a
row; only the frequencies of the few template words are gathered.

Null and empty texts have no words, null first and last word, empty labels and score 0. Every row gives a row, so equal rows and
repeated ids give equal ones; among equally rare words the first by letters votes; an empty table gives no rows; other columns,
whatever their names, are not read; a text of any length is read whole. The frequencies are gathered when the query is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: The words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, told by what they hold: Java matches a positive class several times as fast.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
 including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied
 including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
 whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
_ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
 the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect
 or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
 see the license for the specific language governing permissions and limitations under the license"""
_GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
 this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
 you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"""
_UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
 in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
 we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"""
_MPL = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"
_LGPL, _AGPL = _GPL.replace("general", "lesser general"), _GPL.replace("general", "affero general")
#: name, words, mandatory key phrase (part of them), share of the words that must stand in place. Notices first, then whole headers and licences.
TEMPLATES = [
    ("mit-notice", "released under the mit license", "the mit license", 0.5),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge", 0.5),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0", 0.5),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3", 0.5),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2", 0.5),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license", 0.5),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license", 0.5),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license", 0.5),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that", "redistribution and use in source and binary forms", 0.5),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0", 0.5),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0", 0.5),
    ("cc-by-text", "is licensed under a creative commons attribution", "creative commons attribution", 0.5),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0", 0.5),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software", 0.5),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain", 0.5),
    ("mit-full", _MIT, "permission is hereby granted free of charge", 0.9), ("isc-full", _ISC, "permission to use copy modify and or distribute this software", 0.9), ("bsd-full", _BSD, "redistribution and use in source and binary forms", 0.8),
    ("apache-2.0-header", _APACHE, "apache license version 2 0 the license", 0.7), ("gpl-header", _GPL, "gnu general public license as published by the free software foundation", 0.7),
    ("lgpl-header", _LGPL, "gnu lesser general public license as published by the free software foundation", 0.7), ("agpl-header", _AGPL, "gnu affero general public license as published by the free software foundation", 0.7),
    ("mpl-2.0-header", _MPL, "mozilla public license v 2 0", 0.8), ("unlicense-full", _UNLICENSE, "unencumbered software released into the public domain", 0.9),
]
#: How many words of a key phrase vote.
RARE = 2
VOCABULARY = sorted({w for _, _, key, _ in TEMPLATES for w in key.split()})


def _words(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _low(text: Column) -> Column:
    """lower() also changes other letters, but makes a word of A-Z out of no other one that they hold: only K (Kelvin) becomes an ASCII letter, and phrases and key phrases have no k."""
    return F.lower(text)


def _may(low: Column) -> Column:
    """Every phrase and key phrase holds one of these; a text without them is not cut into words."""
    plain = low.contains("licen") | low.contains("permission") | low.contains("redistribution") | low.contains("creative") | low.contains("unencumbered")
    return plain | low.contains("cc") & low.rlike("cc[^a-z0-9]+by")


def frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and for each template word the number of documents that hold it; all documents count."""
    vocabulary = F.array(*map(F.lit, VOCABULARY))
    own = texts(docs).select(F.array_intersect(_words(_low(F.col("text"))), vocabulary).alias("w"))
    counts = [F.count_if(F.array_contains("w", w)).alias(f"w{k}") for k, w in enumerate(VOCABULARY)]
    row = own.agg(F.count("*").alias("n"), *counts).first()
    return row[0], dict(zip(VOCABULARY, row[1:]))


def postings(df: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """word -> [(template, place)] of the words that vote."""
    out: dict[str, list[tuple[int, int]]] = {}
    for k, (_, t, key, _) in enumerate(TEMPLATES):
        words, phrase = t.split(), key.split()
        lead = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        for w in sorted(set(phrase), key=lambda w: (df[w], w))[:RARE]:
            out.setdefault(w, []).append((k, lead + phrase.index(w)))
    return out


def scan(docs: DataFrame, known: tuple[int, dict[str, int]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs. known: frequencies()."""
    _, df = known or frequencies(docs)
    index = postings(df)
    places = F.create_map(*(x for w, own in sorted(index.items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in own)))))
    need = F.array(*(F.lit(sum(t == k for own in index.values() for t, _ in own)) for k in range(len(TEMPLATES))))

    rows = texts(docs).select("doc_id", _low(F.col("text")).alias("low"))
    rows = rows.select("doc_id", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"), F.when(_may(F.col("low")), _words(F.col("low"))).otherwise(F.array().cast("array<string>")).alias("words"))

    # base phrases: the places of their last word, then the words before it
    def at(phrase: str) -> Column:
        w = phrase.split()
        here = F.filter(F.sequence(F.lit(0), F.size("words") - len(w)), lambda i: _all([F.get("words", i + k) == v for k, v in enumerate(w)]))
        return F.when(F.array_contains("words", w[-1]) & (F.size("words") >= len(w)), here).otherwise(F.array().cast("array<int>"))

    rows = rows.select("*", *(at(p).alias(f"p{k}") for k, (p, _) in enumerate(PHRASES)))
    base = F.concat(*(f"p{k}" for k in range(len(PHRASES))))

    # the file's rare licence words, with their places, vote
    held = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*sorted(index)))
    rows = rows.withColumn("held", F.when(F.size("words") > 0, held))
    votes = F.flatten(F.transform("held", lambda x: F.transform(F.element_at(places, x["w"]), lambda q: F.struct(q["t"].alias("t"), (x["i"] - q["p"]).alias("at")))))
    rows = rows.withColumn("votes", F.array_sort(votes))
    agreed = F.array_distinct(F.filter("votes", lambda v, i: F.get("votes", i + F.element_at(need, v["t"] + 1) - 1) == v))
    rows = rows.withColumn("agreed", agreed)
    nothing = F.array().cast("array<struct<label:string,share:double,enough:boolean>>")
    checks = [F.when(F.exists("agreed", _is(k)), F.transform(F.filter("agreed", _holds(k, t.split(), key.split())), _share(name, t.split(), least))).otherwise(nothing) for k, (name, t, key, least) in enumerate(TEMPLATES)]
    verified = F.when(F.size("agreed") > 0, F.concat(*checks)).otherwise(nothing)
    rows = rows.withColumn("verified", F.filter(verified, lambda v: v["enough"]))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, label) for k, (_, label) in enumerate(PHRASES))))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("verified", lambda v: v["label"]))))
    score = F.greatest(F.when(F.size(base) > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(F.transform("verified", lambda v: v["share"])), F.lit(0.0)))
    return rows.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"), F.array_join(F.array_sort(base_labels), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _is(k: int):
    return lambda v: v["t"] == k


def _holds(k: int, words: list[str], phrase: list[str]):
    """The key phrase stands where the template's place puts it."""
    lead = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return lambda v: (v["t"] == k) & _all([_get(v["at"] + lead + j) == w for j, w in enumerate(phrase)])


def _share(name: str, words: list[str], least: float):
    told = F.array(*map(F.lit, words))

    def share(v):
        same = F.size(F.filter(F.sequence(F.lit(0), F.lit(len(words) - 1)), lambda j: F.coalesce(F.get("words", v["at"] + j) == F.get(told, j), F.lit(False)))) / F.lit(float(len(words)))
        return F.struct(F.lit(name).alias("label"), same.alias("share"), (same >= least).alias("enough"))

    return share


def _get(i: Column) -> Column:
    return F.get("words", i)


def _all(tests) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))
