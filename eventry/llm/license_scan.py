"""Licence scans: TF-IDF cosines of notices to templates, then inheritance from the nearest directory. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventry.llm._shared import cut, spread_join, table
from eventry.llm.license_texts import HEADERS, WORDS

# Usual notices of common licences, by SPDX name.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "Apache-2.0/short": "Licensed under the Apache License, Version 2.0.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "BSD-3-Clause/short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal license.",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MIT/short": "Released under the MIT License.",
    "MIT/licensed": "Licensed under the MIT License.",
    "MIT/terms": "This project is licensed under the terms of the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is released under the zlib License.",
    "proprietary": "All rights reserved.",
}
NOTICE = r"(?i)licen[cs]e|copyright|all rights reserved|hereby granted|permission is granted|redistribution and use|unencumbered software"
# The same where lines are wrapped; and the marks of comment lines.
WRAPPED = NOTICE.replace(" ", "[^a-z0-9]+")
# An empty line within a licence: after a colon, and before a list's next point or a disclaimer.
GAPS = {
    r":[ \t]*\n[^A-Za-z0-9\n]*\n": ":\n",
    r"\n[^A-Za-z0-9\n]*\n([^A-Za-z0-9\n]*(?:[0-9A-Za-z]{1,2}[.)] |[*-] +[A-Za-z]|(?i:neither the name|th(?:is|e) software is provided)))": "\n$1",
}
# What ends a block, by replacements in this order: comment lines are marked, then 0x04 stands where blocks meet.
BREAKS = {
    r"(^|\n)[ \t]*(?://|#|/?\*|--|;|%)([^\n]*)": "$1\x01$2\x02",
    r"\n[^A-Za-z0-9]*\n": "\x04",
    "\x02\n\x01": " ",
    "\x02\n|\n\x01|\\*/": "\x04",
    "[\x01\x02\t-\r ]+": " ",
}
# Licence files: LICENSE, COPYING, NOTICE or UNLICENSE, with a name or version after a hyphen, before a text file's suffix.
LICENCE_FILE = r"(?i)(^|/)((un)?licen[cs]e|copying|notice)(-[a-z0-9.]+|[-_][0-9][0-9._]*)?(\.(txt|md|rst|html|lesser|[0-9]))?$"
# An SPDX tag names a licence, or an expression of several.
SPDX_NAME = r"\(*[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*\+?\)*"
SPDX = rf"SPDX-License-Identifier:[ \t]*({SPDX_NAME}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{SPDX_NAME})*)"
# What names no licence; any licence that a file also names goes before it.
WEAKEST = "proprietary"
THRESHOLD = 0.8
# Words whose idf goes to all tasks; they only make a bound tighter.
COMMON = 20_000


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _sentences(text: Column) -> Column:
    """Sentences and lines of a text that look like a notice."""
    return F.filter(F.split(text, r"[.!?;]\s+|[\r\n]+"), lambda s: s.rlike(NOTICE))


def _blocks(text: Column) -> Column:
    """Blocks of adjoining lines that look like a notice, and the sentences of each, unwrapped.

    A block ends at a line without letters or digits, after ``*/``, and where lines of a comment meet other lines. Where such a line
    stands within a licence (``GAPS``), the blocks on both sides are one more block together.
    """
    text = F.regexp_replace(text, "\r\n?", "\n")
    near = F.filter(F.array_union(_paragraphs(text), _paragraphs(_replaced(text, GAPS))), lambda p: p.rlike(WRAPPED))
    return F.filter(F.array_distinct(F.concat(near, F.flatten(F.transform(near, lambda p: F.split(p, r"[.!?;] +"))))), lambda p: p.rlike(WRAPPED))


def _replaced(text: Column, rules: dict[str, str]) -> Column:
    for pattern, by in rules.items():
        text = F.regexp_replace(text, pattern, by)
    return text


def _paragraphs(text: Column) -> Column:
    return F.transform(F.split(_replaced(text, BREAKS), "\x04"), F.trim)


def notices(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every notice of every whole text (``doc_id, path, notice, block, notice_id``); a licence file is one as a whole, too.

    ``block`` tells the blocks of adjoining lines, and whole licence files, from single lines and sentences; it is null for SPDX tags,
    whose notice is the licence that they name.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    f = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), text.alias("_t"))
    whole = F.when(F.col("path").rlike(LICENCE_FILE), F.array("_t")).otherwise(F.array().cast("array<string>"))
    as_rows = lambda found, block: F.transform(found, lambda n: F.struct(n.alias("notice"), F.lit(block).cast("boolean").alias("block")))
    tags = F.regexp_extract_all("_t", F.lit(SPDX), F.lit(1))
    all_ = F.concat(as_rows(F.concat(_sentences(F.col("_t")), whole), False), as_rows(F.array_distinct(F.concat(_blocks(F.col("_t")), whole)), True), as_rows(tags, None))
    found = f.where(F.col("_t").rlike(WRAPPED) | F.col("path").rlike(LICENCE_FILE)).select("doc_id", "path", F.explode(all_).alias("n"))
    return found.select("doc_id", "path", "n.notice", "n.block").withColumn("notice_id", F.unhex(F.sha2("notice", 256)))


def _templates(spark: SparkSession, block: bool) -> DataFrame:
    """``license, word, tf``: the short templates, for blocks with the standard headers and the whole texts."""
    own = spark.createDataFrame(list((TEMPLATES | HEADERS if block else TEMPLATES).items()), "license string, template string")
    own = own.select("license", F.explode(_tokens(F.col("template"))).alias("word")).groupBy("license", "word").agg(F.count("*").alias("tf"))
    if not block:
        return own
    whole = spark.createDataFrame([(f"{k}/text", v) for k, v in WORDS.items()], "license string, words string")
    whole = whole.select("license", F.explode(F.split("words", " ")).alias("w"))
    return own.union(whole.select("license", F.substring_index("w", ":", 1), F.substring_index("w", ":", -1).cast("long")))


def _words(found: DataFrame) -> DataFrame:
    """``notice_id, word, tf, n``: the words of distinct notices, and how many files' notices are equal."""
    distinct = cut(found.groupBy("notice_id").agg(F.count("*").alias("n"), F.first("notice").alias("notice")))
    return cut(distinct.select("notice_id", "n", F.explode(_tokens(F.col("notice"))).alias("word")).groupBy("notice_id", "word").agg(F.count("*").alias("tf"), F.first("n").alias("n")))


def _promising(found: DataFrame, df: DataFrame, total: int, own: DataFrame, threshold: float) -> DataFrame:
    """As ``_words``, without the notices that can't reach the threshold, so that long blocks of prose are not shuffled by word.

    A cosine to any template is at most the share of the notice's norm that lies in words of templates. The idf of other words is
    exact for the ``COMMON`` most frequent and bounded from below for the rest, so no notice that could pass is left out.
    """
    order = df.orderBy(F.col("df").desc(), "word").limit(COMMON)
    vocab = own.select("word").distinct()
    known = cut(order.unionByName(vocab.join(df, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))).groupBy("word").agg(F.max("df").alias("df")).join(vocab.withColumn("own", F.lit(True)), "word", "left"))
    least = order.agg(F.count("*").alias("n"), F.min("df").alias("df")).first()
    rest = least["df"] if least["n"] == COMMON else 0
    # Distinct notices lie by notice_id, and so do their words: only the texts are shuffled.
    distinct = found.groupBy("notice_id").agg(F.count("*").alias("n"), F.first("notice").alias("notice"))
    words = distinct.select("notice_id", "n", F.explode(_tokens(F.col("notice"))).alias("word")).groupBy("notice_id", "word").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    idf = F.log((F.lit(total) + 1.0) / (F.coalesce("df", F.lit(rest)) + 1.0)) + 1.0
    part = words.join(F.broadcast(known), "word", "left").withColumn("_w", F.pow(F.col("tf") * idf, 2))
    all_ = Window.partitionBy("notice_id")
    part = part.withColumns({"_own": F.sum(F.when(F.col("own"), F.col("_w")).otherwise(0.0)).over(all_), "_all": F.sum("_w").over(all_)})
    return cut(part.where(F.col("_own") >= (threshold - 1e-5) ** 2 * F.col("_all")).select("notice_id", "word", "tf", "n"))


def _nearest(words: DataFrame, df: DataFrame, total: int, own: DataFrame, threshold: float) -> DataFrame:
    idf = F.log((F.lit(total) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    per_template = own.join(df, "word", "left").withColumn("w", F.col("tf") * idf)
    per_template = per_template.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("license")))).select("word", "license", (F.col("w") / F.col("norm")).alias("tw"))
    weighted = spread_join(words, df, ["word"], ["notice_id"], "left").select("notice_id", "word", "tf", (F.col("tf") * idf).alias("w"))
    norms = weighted.groupBy("notice_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("length"))
    # The templates are a fixed list, so their side has a fixed size.
    dots = weighted.join(F.broadcast(per_template), "word").groupBy("notice_id", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "notice_id").select("notice_id", "length", F.substring_index("license", "/", 1).alias("license"), F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scored.groupBy("notice_id", "length").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("b"))
    best = best.select("notice_id", F.col("b.l").alias("license"), (-F.col("b.s")).alias("score"), "length")
    return best.where(F.col("score") >= threshold)


def score_notices(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``notice_id, block, license, score, length`` of each distinct notice that is near enough to a template (length: its words).

    Equal notices are one row from here on, however many files carry them, and their words carry a digest instead of the text.
    A word's idf comes from all single-line notices of the corpus, for blocks too.
    """
    spark = found.sparkSession
    total = found.where("NOT block").count()
    words = _words(found.where("NOT block"))
    df = words.groupBy("word").agg(F.sum("n").alias("df"))
    lines = _nearest(words, df, total, _templates(spark, False), threshold)
    own = _templates(spark, True)
    blocks = _nearest(_promising(found.where("block"), df, total, own, threshold), df, total, own, threshold)
    return lines.withColumn("block", F.lit(False)).unionByName(blocks.withColumn("block", F.lit(True)))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The licence of every file: its own notice nearest to a template, or that of the nearest directory above.

    A file that names its licence by an SPDX tag has that, expressions as they stand. Else the match that covers most decides: its score times the
    words of its notice, so a whole text goes before a sentence of it; "All rights reserved" gives way to any licence. A directory has the licence of its licence files (the best score, then the first
    name). Directories are resolved first, each distinct one once; files then take their directory's. Returns one row per input row:
    ``doc_id, path, own_license, own_score, license, from_dir`` (from_dir is null unless the licence is inherited). Null and empty texts have no
    notice; long texts count whole; of equal matches the first name wins; a null path has no directory; repeated rows give repeated rows; an
    empty table gives no rows; other columns are ignored. Frequent notices, words and directories are dealt in parts.
    """
    found = cut(notices(files, path_col, text_col, id_col))  # texts are read once; licence files and notices go on
    scored = cut(score_notices(found))
    near = spread_join(found.select("doc_id", "path", "notice_id", "block"), scored, ["notice_id", "block"], ["doc_id", "path"]).select("doc_id", "path", "license", "score", "length")
    near = near.withColumn("rank", F.when(F.col("license") == WEAKEST, 2).otherwise(1))
    tagged = found.where("block IS NULL").select("doc_id", "path", F.col("notice").alias("license"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("length"), F.lit(0).alias("rank"))
    first = F.struct("rank", (-F.col("score") * F.col("length")).alias("c"), (-F.col("score")).alias("s"), F.col("license").alias("l"))
    own = near.union(tagged).groupBy("doc_id", "path").agg(F.min(first).alias("b"))
    own = cut(own.select(F.col("doc_id").alias("_id"), F.col("path").alias("_p"), F.col("b.l").alias("own_license"), (-F.col("b.s")).alias("own_score")))
    parent = lambda p: F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).when(p.isNotNull(), "")
    f = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"))
    f = f.join(own, f["doc_id"].eqNullSafe(own["_id"]) & f["path"].eqNullSafe(own["_p"]), "left").select("doc_id", "path", "own_license", "own_score", parent(F.col("path")).alias("dir"))
    licensed = own.where(F.col("_p").rlike(LICENCE_FILE)).groupBy(parent(F.col("_p")).alias("above")).agg(F.min(F.struct((F.col("own_license") == WEAKEST).alias("w"), (-F.col("own_score")).alias("s"), F.col("own_license").alias("l")))["l"].alias("dir_license"))
    dirs = f.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = spread_join(dirs.select("dir", F.posexplode(up).alias("depth", "above")), licensed, ["above"], ["dir"])
    nearest = above.groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license")).alias("n")).select("dir", F.col("n.above").alias("_above"), F.col("n.dir_license").alias("_inherited"))
    return spread_join(f, nearest, ["dir"], ["doc_id", "path"], "left").select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "_inherited").alias("license"), F.when(F.col("own_license").isNull(), F.col("_above")).alias("from_dir")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: directories hold 50 rows, 20 of them stand in one, 10 of those in another.

    The first row of each of the larger directories, and of every second small one, is its licence file.
    """
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    top, mid, low = (F.floor(i / n).cast("string") for n in (10_000, 1_000, 50))
    path = (
        F.when(i % 10_000 == 0, F.concat_ws("/", top, F.lit("LICENSE")))
        .when(i % 1_000 == 0, F.concat_ws("/", top, mid, F.lit("LICENSE")))
        .when(i % 100 == 0, F.concat_ws("/", top, mid, low, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", top, mid, low, F.concat(i.cast("string"), F.lit(".txt"))))
    )
    return scan_licenses(docs.withColumn("path", path))


QUERIES = {"op3_license_scan": op3_license_scan}
_SQL_TOKENS = "[x FOR x IN regexp_split_to_array(lower({}), '[^a-z0-9]+') IF x <> '']"
_NOTICE_SQL, _WRAPPED_SQL = NOTICE.replace("(?i)", ""), WRAPPED.replace("(?i)", "")


def _values(rows: dict[str, str]) -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in rows.items())


def _replaced_sql(text: str, rules: dict[str, str]) -> str:
    """The same replacements; SQL strings hold control characters as ``chr``."""
    quote = lambda x: "'" + "".join(f"' || chr({ord(c)}) || '" if c < " " else c for c in x) + "'"
    for pattern, by in rules.items():
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(by.replace('$', chr(92)))}, 'g')"
    return text


_JOINED = _replaced_sql("u", GAPS)
_PARTS = [f"list_transform(string_split({_replaced_sql(x, BREAKS)}, chr(4)), lambda p: trim(p))" for x in ("u", "j")]
ORACLES = {
    "op3_license_scan": rf"""
        WITH p AS (SELECT doc_id, coalesce(text, '') AS t, CAST(doc_id // 10000 AS VARCHAR) AS top, CAST(doc_id // 1000 AS VARCHAR) AS mid, CAST(doc_id // 50 AS VARCHAR) AS low FROM documents),
        f AS (SELECT doc_id, t, CASE WHEN doc_id % 10000 = 0 THEN top || '/LICENSE' WHEN doc_id % 1000 = 0 THEN top || '/' || mid || '/LICENSE'
                                     WHEN doc_id % 100 = 0 THEN top || '/' || mid || '/' || low || '/LICENSE' ELSE top || '/' || mid || '/' || low || '/' || doc_id || '.txt' END AS path FROM p),
        lines AS (SELECT doc_id, path, unnest([x FOR x IN regexp_split_to_array(t, '[.!?;]\s+|[\r\n]+') IF regexp_matches(x, '{_NOTICE_SQL}', 'i')] ||
                     CASE WHEN ends_with(path, '/LICENSE') THEN [t] ELSE [] END) AS notice FROM f),
        u AS (SELECT doc_id, path, t, regexp_replace(t, '\r\n?', chr(10), 'g') AS u FROM f WHERE ends_with(path, '/LICENSE') OR regexp_matches(t, '{_WRAPPED_SQL}', 'i')),
        j AS (SELECT *, {_JOINED} AS j FROM u),
        near AS (SELECT doc_id, path, unnest(list_filter({_PARTS[0]} || {_PARTS[1]}, lambda p: regexp_matches(p, '{_WRAPPED_SQL}', 'i'))) AS p FROM j),
        blocks AS (SELECT DISTINCT doc_id, path, notice FROM (SELECT doc_id, path, unnest([p] || regexp_split_to_array(p, '[.!?;] +')) AS notice FROM near)
                   WHERE regexp_matches(notice, '{_WRAPPED_SQL}', 'i') UNION SELECT doc_id, path, t FROM u WHERE ends_with(path, '/LICENSE')),
        c AS (SELECT *, false AS block FROM lines UNION ALL SELECT *, true FROM blocks),
        d AS (SELECT notice, block, count(*) AS n FROM c GROUP BY ALL),
        total AS (SELECT coalesce(sum(n), 0) AS total FROM d WHERE NOT block),
        words AS (SELECT notice, block, word, count(*) AS tf, any_value(n) AS n FROM (SELECT notice, block, n, unnest({_SQL_TOKENS.format('notice')}) AS word FROM d) GROUP BY notice, block, word),
        df AS (SELECT word, sum(n) AS df FROM words WHERE NOT block GROUP BY word),
        given AS (SELECT *, false AS block FROM (VALUES {_values(TEMPLATES)}) v(license, template) UNION ALL SELECT *, true FROM (VALUES {_values(TEMPLATES | HEADERS)}) v(license, template)),
        t0 AS (SELECT license, block, word, count(*) AS tf FROM (SELECT license, block, unnest({_SQL_TOKENS.format('template')}) AS word FROM given) GROUP BY ALL
               UNION ALL SELECT license || '/text', true, split_part(w, ':', 1), CAST(split_part(w, ':', 2) AS BIGINT)
               FROM (SELECT license, unnest(string_split(words, ' ')) AS w FROM (VALUES {_values(WORDS)}) v(license, words))),
        t1 AS (SELECT license, block, t0.word, tf * (ln((total + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0) AS w FROM t0 LEFT JOIN df USING (word), total),
        t2 AS (SELECT license, block, word, w / sqrt(sum(w * w) OVER (PARTITION BY license, block)) AS tw FROM t1),
        w AS (SELECT notice, block, words.word, tf, tf * (ln((total + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0) AS w FROM words LEFT JOIN df USING (word), total),
        norms AS (SELECT notice, block, sqrt(sum(w * w)) AS norm, sum(tf) AS length FROM w GROUP BY ALL),
        s AS (SELECT notice, block, any_value(length) AS length, split_part(license, '/', 1) AS license, round(sum(w.w * tw) / any_value(norm), 6) AS score
              FROM w JOIN t2 USING (word, block) JOIN norms USING (notice, block) GROUP BY notice, block, t2.license),
        b AS (SELECT * FROM s WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY notice, block ORDER BY score DESC, license) = 1),
        o AS (SELECT doc_id, path, license, score, length, CASE license WHEN '{WEAKEST}' THEN 2 ELSE 1 END AS rank FROM c JOIN b USING (notice, block) UNION ALL
              SELECT doc_id, path, x, 1.0, 0, 0 FROM (SELECT doc_id, path, unnest(regexp_extract_all(t, '{SPDX}', 1)) AS x FROM f)),
        own AS (SELECT doc_id, path, license AS own_license, score AS own_score FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY rank, score * length DESC, score DESC, license) = 1),
        dirs AS (SELECT regexp_replace(path, '/[^/]*$', '') AS above, own_license AS dir_license FROM own WHERE ends_with(path, '/LICENSE')
                 QUALIFY row_number() OVER (PARTITION BY above ORDER BY own_license = '{WEAKEST}', own_score DESC, own_license) = 1),
        up AS (SELECT doc_id, path, i, array_to_string(parts[1:i], '/') AS above FROM (
                 SELECT doc_id, path, parts, unnest(range(0, len(parts))) AS i FROM (SELECT doc_id, path, string_split(path, '/') AS parts FROM f))),
        nearest AS (SELECT doc_id, path, above, dir_license FROM up JOIN dirs USING (above) QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY i DESC) = 1)
        SELECT f.doc_id, f.path, own_license, own_score, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NULL THEN above END AS from_dir
        FROM f LEFT JOIN own USING (doc_id, path) LEFT JOIN nearest USING (doc_id, path)"""
}
