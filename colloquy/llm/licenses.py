"""License scans: TF-IDF cosine of text lines to licence templates, and inheritance by directory.

Every line of a file and every block of up to ``BLOCK`` consecutive lines with words is a candidate
header.  Its sparse TF-IDF vector (document frequencies of the template terms are counted over all
files; every other term has the weight of an unseen one) is compared with each template; the best
one at ``HEADER`` or above licenses the file directly.  A block is scored only where a bound from its
lines' products and norms lets it win, so none is lost.  A file is a licence file if its whole text,
as one vector, reaches ``WHOLE``, whatever its lines score, or if it is named like one and a header
reaches ``HEADER``; it licenses its directory.  Other files inherit from the nearest
ancestor directory with a licence file: the distinct directories are joined with their ancestors
first, then the files with their directory.

Lines and blocks are compared with the short notices and with the standard headers, whole files with
these and with the licence texts; each of the three lists has term weights of its own.  A licence text
goes before what stands inside it ("All rights reserved." in a BSD file), as does a standard header
before a notice of fewer words.

Ties between templates go to the first in the list, between licence files of a directory to the
higher cosine, then the smaller id.  Null or empty texts have no licence of their own but inherit;
a null path inherits nothing; rows are independent; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import stage

HEADER, WHOLE = 0.8, 0.85
#: Lines of the longest header.
BLOCK = 20
#: Short notices (fixed values): identifier, text.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("Proprietary", "All rights reserved."),
)
def _texts(at) -> tuple[tuple[str, str], ...]:
    return tuple((f.name.removesuffix(".txt"), f.read_text("utf-8"))
                 for f in sorted(at.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt"))


#: Licence texts, compared with whole files, and standard headers of several lines.
TEXTS = _texts(resources.files("colloquy.llm") / "licence_texts")
HEADERS = _texts(resources.files("colloquy.llm") / "licence_texts" / "headers")
_NAMED = re.compile(r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$")
_TERM = re.compile(r"[a-z0-9]+")
_FOUND = "struct<license:string,cosine:double>"


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def _sum(counts: list[Counter]) -> Counter:
    out = Counter()
    for c in counts:
        out.update(c)
    return out


class Matcher:
    """Template vectors under given document frequencies."""

    def __init__(self, templates, df: dict[str, int], n_docs: int):
        idf = lambda k: math.log((1 + n_docs) / (1 + k)) + 1
        self.unseen = idf(0)
        tf = [(name, Counter(terms(text))) for name, text in templates]
        self.idf = {t: idf(df.get(t, 0)) for _, c in tf for t in c}
        self.rows = []
        for name, c in tf:
            v = {t: k * self.idf[t] for t, k in c.items()}
            self.rows.append((name, v, math.sqrt(sum(x * x for x in v.values()))))
        self.terms = frozenset(self.idf)
        self.zeros, self.norms = [0.0] * len(tf), np.array([norm for _, _, norm in self.rows])

    def weigh(self, c: Counter) -> tuple[list[float], float]:
        """Products with the template vectors, and the squared norm."""
        mine = {t: c[t] * self.idf[t] for t in self.terms.intersection(c)}
        norm2 = sum(x * x for x in mine.values())
        norm2 += sum(k * k for t, k in c.items() if t not in mine) * self.unseen ** 2
        return [sum(x * v[t] for t, x in mine.items() if t in v) for _, v, _ in self.rows] if mine else self.zeros, norm2

    def top(self, dots: list[float], norm2: float, least: float) -> tuple[str, float] | None:
        top = None
        for (name, _, norm), dot in zip(self.rows, dots):
            # rounded, so that equal cosines tie whatever the order of summation
            cos = round(dot / (norm * math.sqrt(norm2)), 9) if dot else 0.0
            if cos >= least and (top is None or cos > top[1]):
                top = name, cos
        return top

    def best(self, words: list[str], least: float) -> tuple[str, float] | None:
        return self.top(*self.weigh(Counter(words)), least)

    def header(self, lines: list[Counter], least: float) -> tuple[str, float, int] | None:
        """Best line or block, and its number of words; ties go to the shorter and then the earlier one."""
        weighed = [self.weigh(c) for c in lines]
        top = None
        for c, w in zip(lines, weighed):
            got = self.top(*w, least)
            if got and (top is None or got[1] > top[1]):
                top = *got, c.total()
        most = min(BLOCK, len(lines))
        # counts only add up: |a + b|^2 >= |a|^2 + |b|^2, so no block exceeds sqrt(lines) times its best line
        if most < 2 or not any(self.top(*w, least / math.sqrt(most) - 1e-6) for w in weighed):
            return top
        each = np.array([d for d, _ in weighed]) / self.norms, np.array([n for _, n in weighed])
        dots, norm2 = each
        for size in range(2, most + 1):
            dots, norm2 = dots[:-1] + each[0][size - 1:], norm2[:-1] + each[1][size - 1:]
            bound = dots.max(axis=1) / np.sqrt(norm2)
            for i in np.flatnonzero(bound >= (top[1] if top else least) - 1e-6).tolist():
                c = _sum(lines[i:i + size])
                got = self.top(*self.weigh(c), least)
                if got and (top is None or got[1] > top[1]):
                    top = *got, c.total()
        return top


def frequencies(files: DataFrame, templates=TEMPLATES) -> tuple[dict[str, int], int]:
    """Number of files that have each template term, and of all files."""
    vocab = sorted({t for _, x in templates for t in terms(x)})
    present = F.array_intersect(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), 0),
                                F.split(F.lit(" ".join(vocab)), " "))
    rows = files.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
    got = {r.t: r.n for r in rows}
    return got, got.pop("", 0)


def judge(text: str, path: str | None, notices: Matcher, headers: Matcher, texts: Matcher) -> tuple[tuple | None, tuple | None]:
    """The licence of a file, and the one it gives to its directory: (identifier, cosine)."""
    lines = [Counter(ws) for ws in map(terms, text.split("\n")) if ws]
    whole = _sum(lines)
    file = texts.top(*texts.weigh(whole), WHOLE)
    if file:
        return file, file
    short, long = notices.header(lines, HEADER), headers.header(lines, HEADER)
    best = max((x for x in (short, long) if x), key=lambda x: (x[2], x[1]), default=None)
    best = best and best[:2]
    file = max((x for m in (notices, headers) if (x := m.top(*m.weigh(whole), WHOLE))), key=lambda x: x[1], default=None)
    if file and (best is None or file[1] > best[1]):
        best = file
    if best and not file and _NAMED.match((path or "").rpartition("/")[2]):
        file = best
    return best, file


def direct(files: DataFrame, templates=TEMPLATES, headers=HEADERS, texts=TEXTS) -> DataFrame:
    """file_id, path, the file's own licence and, for licence files, the directory's."""
    df, n = frequencies(files, (*templates, *headers, *texts))
    sent = files.sparkSession.sparkContext.broadcast([Matcher(x, df, n) for x in (templates, headers, texts)])
    src = files.select("file_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    kind = src.schema["file_id"].dataType.simpleString()
    struct = pa.struct([("license", pa.string()), ("cosine", pa.float64())])

    def run(batches):
        for b in batches:
            own, whole = [], []
            for text, path in zip(b.column("text").to_pylist(), b.column("path").to_pylist()):
                best, file = judge(text, path, *sent.value)
                own.append(best and dict(zip(("license", "cosine"), best)))
                whole.append(file and dict(zip(("license", "cosine"), file)))
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("path"), pa.array(own, struct), pa.array(whole, struct)],
                                             names=["file_id", "path", "own", "whole"])

    return src.mapInArrow(run, f"file_id {kind}, path string, own {_FOUND}, whole {_FOUND}")


def scan(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """file_id, path, license, cosine, origin ('header', 'directory' or null), from_dir, depth."""
    parts = F.split("path", "/")
    rows = stage(direct(files, templates).withColumn(
        "dir", F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")), "licences")
    given = (rows.where("whole is not null and dir is not null").groupBy("dir").agg(
        F.min(F.struct((-F.col("whole.cosine")).alias("c"), F.col("file_id"), F.col("whole.license").alias("license"))).alias("w"))
        .select(F.col("dir").alias("from_dir"), F.col("w.license").alias("dir_license"), (-F.col("w.c")).alias("dir_cosine")))
    dirs = rows.select("dir").where("dir is not null").distinct()
    steps = F.split("dir", "/")
    up = dirs.select("dir", F.posexplode(F.concat(F.array(F.lit("")), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))))).alias("depth", "from_dir"))
    near = (up.join(given, "from_dir").withColumn("_r", F.row_number().over(W.partitionBy("dir").orderBy(F.desc("depth"))))
            .where("_r = 1").drop("_r"))
    out = rows.join(near, "dir", "left")
    own = F.col("own.license").isNotNull()
    return out.select("file_id", "path", F.coalesce("own.license", "dir_license").alias("license"),
                      F.round(F.when(own, F.col("own.cosine")).otherwise(F.col("dir_cosine")), 6).alias("cosine"),
                      F.when(own, F.lit("header")).when(F.col("dir_license").isNotNull(), F.lit("directory")).alias("origin"),
                      F.when(~own, F.col("from_dir")).alias("from_dir"), F.when(~own, F.col("depth")).cast("int").alias("depth"))
