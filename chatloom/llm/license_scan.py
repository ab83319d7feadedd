"""Licence scan with a positional rare-token index, in DataFrame functions only.

A template matches in a band of shifts: from the first word of its key phrase, a chain walks through its words in both
directions. The next word is taken at its place after the last one found, else at the nearest place up to ``GAP`` words
further (or closer, where template words lack) whose following word is the template's next too; places stay within the
template's band of shifts (8 words and a quarter of its length). So inserted words (comment signs, line numbers, numbers of
clauses) and left out or changed ones cost themselves only. A match covers ``COVER`` of the template's words; those of the
key phrase must all be in the chain.

A first pass counts in how many documents each word of the templates stands, which gives its IDF (one row for each
template word, so the counts are small enough for the driver). Each template is then indexed at its rarest places: as
many as an accepted match can lack, and ``AGREE`` more. A file looks up its licence words of highest IDF, those that stand
at such a place; every posting gives a template and a start (position - offset), and votes for two overlapping buckets of
starts, each as wide as the band. Buckets in which ``AGREE`` places of a template agree go on, and by the number of places
indexed no accepted match is missed. There the key phrase's first word is looked for and the chain is walked. All of this
stays inside the row, so no shuffle follows the corpus counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.util import table

#: Base phrases and labels of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public licence notices, paragraph by paragraph: label, words, and the key phrase that must stand in it.
NOTICES = (
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge"),
    ("mit-line", "released under the mit license", "mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-line", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "without limitation the rights to use"),
    ("mit-conditions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copies or substantial portions of the software"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "other dealings in the software"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "required by applicable law or agreed to in writing"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "published by the free software foundation"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "other materials provided with the distribution"),
    ("bsd-names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("bsd-warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "even if advised of the possibility of such damage"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "appear in all copies"),
    ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable"),
    ("zlib-conditions", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "alter it and redistribute it freely"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying documentation covered by this license"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "as long as the name is changed"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
)
#: Whole licence bodies: label, the notices they are made of or further words, and the key phrase.
BODIES = (
    ("mit-text", ("mit-grant", "mit-conditions", "mit-warranty"), "copies or substantial portions of the software"),
    ("bsd-2-clause-text", ("bsd", "bsd-source", "bsd-binary", "bsd-warranty"), "other materials provided with the distribution"),
    ("bsd-3-clause-text", ("bsd", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty"), "endorse or promote products derived from this software"),
    ("isc-text", ("isc-notice", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"), "negligence or other tortious action"),
)
_NAMED = {name: text for name, text, _ in NOTICES}
TEMPLATES = (*NOTICES, *((name, " ".join(_NAMED.get(p, p) for p in parts), key) for name, parts, key in BODIES))
#: Share of a template's words that an alignment must cover.
COVER = 0.8
#: Places that must agree on a start.
AGREE = 2
#: Words that may be inserted between two words of a template.
GAP = 3
#: Added to starts, which may lie before the text.
_SHIFT = 4096


def _offset(text: str, key: str) -> int:
    own, k = text.split(), key.split()
    return next(o for o in range(len(own)) if own[o : o + len(k)] == k)


#: Where each template's key phrase begins.
_KEY = [_offset(text, key) for _, text, key in TEMPLATES]
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()} | {w for p in BASE for w in p.split()})


def _kept(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row: a generator is a barrier to the merging of projections, which would
    put a costly expression into the lambdas that read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, w): the words of every text."""
    text = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = _kept(docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")), "_s", F.split("_t", _SEPARATOR))
    # a text that begins or ends with separators gives empty strings there
    lead = F.when(F.element_at("_s", 1) == "", 1).otherwise(0)
    tail = F.when((F.size("_s") > 1) & (F.element_at("_s", -1) == ""), 1).otherwise(0)
    return _kept(out, "w", F.slice("_s", lead + 1, F.size("_s") - lead - tail)).select("doc_id", "w")


def _words(text: str) -> Column:
    """A constant array of words."""
    return F.split(F.lit(text), " ")


def rarity(words: DataFrame) -> dict[str, float]:
    """IDF of every word of the templates over all documents."""
    known = _words(" ".join(vocabulary()))
    counts = words.select(F.explode(F.concat(F.array_intersect("w", known), F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    found = {r["w"]: r["df"] for r in counts.collect()}
    total = found.get("", 0)
    return {w: math.log((total + 1) / (found.get(w, 0) + 0.5)) for w in vocabulary()}


def postings(idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Word -> (template, offset) at the rarest places of each template (all have more than ``AGREE`` words)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, text, _) in enumerate(TEMPLATES):
        own = text.split()
        for o in sorted(range(len(own)), key=lambda o: (-idf[own[o]], o))[: lacking(text) + AGREE]:
            out.setdefault(own[o], []).append((t, o))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of every row: the columns of the contract and ``template`` (best covered one, or null).

    Null and empty text have no words and score 0; very long texts are scanned whole; repeated rows are scanned apart, rows
    without id like others; an empty table gives none; other columns are ignored.
    """
    words = with_words(docs, id_col, text_col)
    index = postings(rarity(words))
    anchors = _words(" ".join(sorted({*index, "license"})))
    # the file's own index words are few: its places are compared with those alone
    rows = _kept(words, "own", F.array_intersect("w", anchors))
    places = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("w"), i.alias("p"))), lambda s: F.array_contains("own", s["w"]))
    rows = _kept(rows, "h", F.when(F.size("own") > 0, places).otherwise(F.array().cast("array<struct<w:string,p:int>>")))

    # base phrases end in the same word: every place of it is tried
    tried = [_places(phrase.split(), label) for phrase, label in BASE.items()]
    rows = _kept(rows, "base", F.when(F.size("h") > 0, F.concat(*tried)).otherwise(F.array().cast("array<struct<p:int,label:string>>")))

    codes = {w: ", ".join(f"struct({t} AS t, {o} AS o, {2 * band(t)} AS wide)" for t, o in own) for w, own in sorted(index.items())}
    listed = F.expr("map(" + ", ".join(f"'{w}', array({own})" for w, own in codes.items()) + ")")

    def votes(s: Column, q: Column) -> Column:
        bucket = F.floor((s["p"] - q["o"] + _SHIFT) / q["wide"])
        return F.array(_code(q["t"], bucket) * 512 + q["o"], _code(q["t"], bucket + 1) * 512 + q["o"])

    cast = F.flatten(F.transform(F.filter("h", lambda s: F.map_contains_key(listed, s["w"])), lambda s: F.flatten(F.transform(listed[s["w"]], lambda q: votes(s, q)))))
    longs = F.array().cast("array<bigint>")
    rows = _kept(rows, "voted", F.when(F.size("h") >= AGREE, F.array_sort(F.array_distinct(cast))).otherwise(longs))
    # places of one bucket stand together
    agreed = F.filter("voted", lambda a, i: F.coalesce(F.shiftright(F.get("voted", i - (AGREE - 1)), 9) == F.shiftright(a, 9), F.lit(False)))
    rows = _kept(rows, "agreed", F.when(F.size("voted") >= AGREE, F.array_distinct(F.transform(agreed, lambda a: F.shiftright(a, 9)))).otherwise(longs))
    places = F.array_distinct(F.flatten(F.transform("agreed", _key_places)))
    rows = _kept(rows, "keys", F.when(F.size("agreed") > 0, places).otherwise(longs))
    chains = F.filter(F.transform("keys", _chain), lambda x: x.isNotNull() & (x["c"] >= COVER))
    rows = _kept(rows, "scored", F.when(F.size("keys") > 0, chains).otherwise(F.array().cast("array<struct<c:double,back:int>>")))
    names = F.array(*[F.lit(n) for n, _, _ in TEMPLATES])
    best = F.array_max("scored")
    base_labels = F.transform("base", lambda x: x["label"])
    starts = F.transform("base", lambda x: x["p"])
    own_labels = F.transform("scored", lambda x: F.get(names, F.lit(len(TEMPLATES)) - x["back"]))
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own_labels))), ",").alias("labels"),
        F.greatest(F.coalesce(best["c"], F.lit(0.0)), F.when(F.size("base") > 0, F.lit(COVER)).otherwise(F.lit(0.0))).alias("score"),
        F.get(names, F.lit(len(TEMPLATES)) - best["back"]).alias("template"),
    )


def _places(own: list[str], label: str) -> Column:
    """Where a phrase stands, found from its last word."""
    last = len(own) - 1

    def stands(s: Column) -> Column:
        out = (s["w"] == own[last]) & (s["p"] >= last)
        for k in range(last):
            out = out & F.coalesce(F.get("w", s["p"] - (last - k)) == own[k], F.lit(False))
        return out

    return F.transform(F.filter("h", stands), lambda s: F.struct((s["p"] - last).alias("p"), F.lit(label).alias("label")))


def band(t: int) -> int:
    """How far a template's words may be shifted against the first word of its key phrase."""
    return 8 + len(TEMPLATES[t][1].split()) // 4


def _code(t: Column, x: Column) -> Column:
    """Template and a number below 2^32 as one number."""
    return t.cast("long") * (1 << 32) + x


def _of(values: list[int], t: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), t)


def _key_places(agreed: Column) -> Column:
    """Places at which the key phrase's first word stands so that its chain may hold the places that agree."""
    t = F.shiftright(agreed, 32).cast("int")
    bucket = agreed.bitwiseAND((1 << 32) - 1)
    width = _of([2 * band(k) for k in range(len(TEMPLATES))], t)
    at = _of(_KEY, t) - _SHIFT
    low = F.greatest(F.lit(0), (bucket - 1) * width - F.floor(width / 2) + at)
    high = F.greatest(low, (bucket + 1) * width + F.floor(width / 2) + at)
    first = F.get(F.array(*[F.lit(key.split()[0]) for _, _, key in TEMPLATES]), t)
    return F.transform(F.filter(F.sequence(low, high), lambda p: F.coalesce(F.get("w", p.cast("int")) == first, F.lit(False))), lambda p: _code(t, p))


def _chain(key: Column) -> Column:
    """(share of the template's words in the chain, template from behind), or null where words of the key phrase lack."""
    t, start = F.shiftright(key, 32).cast("int"), key.bitwiseAND((1 << 32) - 1).cast("int")
    own = F.get(F.array(*[_words(text) for _, text, _ in TEMPLATES]), t)
    key_at, length = _of(_KEY, t), _of([len(text.split()) for _, text, _ in TEMPLATES], t)
    key_end = key_at + _of([len(key.split()) for _, _, key in TEMPLATES], t)
    reach, most = _of([band(k) for k in range(len(TEMPLATES))], t), _of([lacking(text) for _, text, _ in TEMPLATES], t)

    def walk(offsets: Column, begin: Column, sign: int) -> Column:
        def step(s: Column, o: Column) -> Column:
            def stands(d: Column, k: int) -> Column:
                return F.get("w", s["p"] + sign * (d + k)) == F.get(own, o + sign * k)

            def fits(d: Column) -> Column:
                return F.coalesce(stands(d, 0), F.lit(False)) & (F.abs(s["p"] + sign * d - start - o + key_at) <= reach)

            last = F.get(own, o + sign).isNull()
            jump = F.array_min(F.filter(F.sequence(F.lit(1), s["m"] + 1 + GAP), lambda d: fits(d) & (last | F.coalesce(stands(d, 1), F.lit(False)))))
            # a chain that lacks more words in a row than a match can is lost
            found = F.when(s["m"] > most, F.lit(None).cast("int")).when(fits(s["m"] + 1), s["m"] + 1).otherwise(jump)
            # the list of one makes it a value that is read thrice and computed once
            return F.get(
                F.transform(
                    F.array(found),
                    lambda d: F.struct((s["p"] + sign * F.coalesce(d, F.lit(0))).alias("p"), F.when(d.isNull(), s["m"] + 1).otherwise(0).alias("m"), (s["c"] + F.when(d.isNull(), 0).otherwise(1)).alias("c")),
                ),
                F.lit(0),
            )

        return F.aggregate(offsets, begin, step)

    def offsets(low: Column, high: Column) -> Column:
        """low to high - 1"""
        return F.when(high > low, F.sequence(low, F.greatest(low, high - 1))).otherwise(F.array().cast("array<int>"))

    def state(p: Column, c: int) -> Column:
        return F.struct(p.alias("p"), F.lit(0).alias("m"), F.lit(c).alias("c"))

    phrase = walk(offsets(key_at + 1, key_end), state(start, 1), 1)
    whole = F.filter(F.array(phrase), lambda s: s["c"] == key_end - key_at)
    after = F.transform(whole, lambda s: walk(offsets(key_end, length), s, 1))
    both = F.transform(after, lambda s: s["c"] + walk(F.reverse(offsets(F.lit(0), key_at)), state(start, 0), -1)["c"])
    return F.get(F.transform(both, lambda c: F.struct((c.cast("double") / length).alias("c"), (F.lit(len(TEMPLATES)) - t).alias("back"))), F.lit(0))


def lacking(text: str) -> int:
    """Words of a template that an accepted match can lack."""
    own = text.split()
    return len(own) - math.ceil(COVER * len(own) - 1e-9)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL: a chain is walked from every place of a key phrase's first word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    base = " || ".join(
        "[{p: i - 1, label: '" + label + "'} FOR i IN range(1, len(w) + 1) IF " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) + "]" for phrase, label in BASE.items()
    )
    templates = ", ".join(
        f"({t}, '{name}', {listed(text.split())}, {_KEY[t]}, {_KEY[t] + len(key.split())}, {band(t)}, {lacking(text)})" for t, (name, text, key) in enumerate(TEMPLATES)
    )
    firsts = listed(sorted({key.split()[0] for _, _, key in TEMPLATES}))
    # a chain stays within the length and the band of its template: r words on both sides are enough; the start stands at win[r + 1]
    return rf"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), base AS (SELECT id, doc_id, len(w)::BIGINT AS n_words, {base} AS b FROM words),
templates(t, name, own, key_at, key_end, band, most) AS (VALUES {templates}),
placed AS (SELECT id, w, unnest([i FOR i IN range(1, len(w) + 1) IF list_contains({firsts}, w[i])]) AS a FROM words),
keys AS (
  SELECT id, a, t, own, key_at, key_end, band, most, len(own) + band + 2 AS r,
    [CASE WHEN i >= 1 THEN w[i] END FOR i IN range(a - len(own) - band - 2, a + len(own) + band + 3)] AS win
  FROM placed JOIN templates ON w[a] = own[key_at + 1]
), chain AS (
  SELECT id, a, t, own, key_at, key_end, band, most, r, win, s AS sign, key_at AS o, 0 AS p, 0 AS m, CASE WHEN s = 1 THEN 1 ELSE 0 END AS c FROM keys, (VALUES (1), (-1)) signs(s)
  UNION ALL
  SELECT id, a, t, own, key_at, key_end, band, most, r, win, sign, o + sign, p + sign * coalesce(d, 0), CASE WHEN d IS NULL THEN m + 1 ELSE 0 END, c + CASE WHEN d IS NULL THEN 0 ELSE 1 END
  FROM (
    SELECT *, CASE WHEN win[r + 1 + p + sign * (m + 1)] = own[o + sign + 1] AND abs(p + sign * (m + 1) - o - sign + key_at) <= band THEN m + 1
      ELSE list_min([d FOR d IN range(1, m + 2 + {GAP}) IF abs(p + sign * d - o - sign + key_at) <= band AND win[r + 1 + p + sign * d] = own[o + sign + 1]
        AND (o + 2 * sign NOT BETWEEN 0 AND len(own) - 1 OR win[r + 1 + p + sign * (d + 1)] = own[o + 2 * sign + 1])]) END AS d
    FROM chain WHERE o + sign BETWEEN 0 AND len(own) - 1
  ) WHERE (d IS NOT NULL OR (m < most AND (sign = -1 OR o + 1 >= key_end)))
), covers AS (
  SELECT f.id, f.t, (f.c + b.c)::DOUBLE / len(f.own) AS c FROM chain f JOIN chain b USING (id, a, t) WHERE f.sign = 1 AND f.o = len(f.own) - 1 AND b.sign = -1 AND b.o = 0
), best AS (SELECT id, max(c) AS c, list(DISTINCT name) AS names, first(name ORDER BY c DESC, t) AS template FROM covers JOIN templates USING (t) WHERE c >= {COVER} GROUP BY id)
SELECT doc_id, n_words, len(b)::BIGINT AS n_base, list_min([x.p FOR x IN b])::BIGINT AS first_word, list_max([x.p FOR x IN b])::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct([x.label FOR x IN b])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct([x.label FOR x IN b] || coalesce(names, []))), ',') AS labels,
  greatest(coalesce(c, 0.0), CASE WHEN len(b) > 0 THEN {COVER} ELSE 0.0 END)::DOUBLE AS score, template
FROM base LEFT JOIN best USING (id)
"""
