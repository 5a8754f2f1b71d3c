"""How demanding a document's prose is to read: regularised ordinal regression on features of its Markdown text.

One pass in Python takes the prose out of each rendered notebook, splits it into sentences and words and stores words, their places and the features that need nothing else. Counts of all
words over all prose are summed in the JVM and give the rarity of each. The judged documents of a bounded sample give the graded lexicon, by an aggregate, and
the regression, from their feature vectors alone; the fitted model, of bounded size, then goes over the stored words of all documents. Features: length of sentences and words, lexical
diversity, rarity, connectives, a proxy of clause depth, and the mean grade of words in the judged texts.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolattice.runtime import Written

#: Bounds of the fitted model: most judged documents it is fitted on, and words of its graded lexicon.
MOST_LABELLED, LEXICON_WORDS = 12_000, 50_000
#: The most frequent words, whose rarity is looked up in a table sent to all tasks; that of all others is joined by word. The results are the same.
TABLE_WORDS = 50_000

#: Words that open clauses or tie them together, in the languages of the corpus.
CONNECTIVES = frozenset(
    "which that whose whom whether although though whereas unless because since while until if when where than however therefore hence thus moreover nevertheless notwithstanding insofar "
    "dont lequel laquelle lesquels que qui quoique bien puisque parce tandis lorsque afin néanmoins cependant toutefois ainsi quand comme si "
    "dass ob obwohl weil während sofern insofern deren dessen welche welcher welches damit sodass nachdem bevor jedoch dennoch demgegenüber wenn als "
    "cuyo cuya cual aunque porque mientras cuando siempre puesto salvo embargo obstante según como".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_STOP = re.compile(r"[.!?…]+(?=\s|$)|\n+")
_PROMPT = re.compile(r"^(?:In|Out) ?\[[ \d]*\]:")
_CELL = re.compile(r"^# ?%%(.*)$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_DROP_LINE = re.compile(r"^\s*(?:#{1,6}(?:\s|$)|>|\||</?\w|!\[|[-=*_]{3,}\s*$)")
_INLINE = re.compile(r"`[^`\n]*`|\$[^$\n]*\$|!?\[([^\]\n]*)\]\([^)\n]*\)|</?[A-Za-z][^>\n]*>|https?://\S+|\x1b\[[0-9;]*m")
_BULLET = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
_ANSI = re.compile(r"\x1b\[[0-9;]*m")
_TRACE = re.compile(r"^(?:Traceback \(most recent call last\)|-{20,}|\s+File \"|\w*(?:Error|Exception|Warning)\b.*:)")


def _markdown(text: str) -> str:
    """Paragraph text of Markdown: without code, quotes, tables, headings, formulas and images."""
    out: list[str] = []
    fence = None
    formula = quoted = False
    for line in text.split("\n"):
        if m := _FENCE.match(line):
            if fence is None:
                fence = m[1]
            elif m[1].startswith(fence[0]) and len(m[1]) >= len(fence):
                fence = None
            continue
        bare = line.strip()
        if fence is not None:
            continue
        if not bare:
            quoted = False
            out.append("")
        elif formula or bare.startswith(("$$", "\\[", "\\begin")):
            ends = bare.endswith(("$$", "\\]")) or "\\end{" in bare
            formula = not (ends and (formula or len(bare) > 3))
        elif line.startswith(("    ", "\t")) and not _BULLET.match(line):
            continue
        elif bare.startswith(">"):
            quoted = True
        elif quoted or _DROP_LINE.match(line):
            continue  # a paragraph that goes on after > is still quoted
        else:
            out.append(_INLINE.sub(lambda m: m[1] or " ", _BULLET.sub("", line)))
    return "\n".join(out).strip()


def _connected(block: str) -> bool:
    bare = block.strip()
    return bare[-1:] in set(".!?…:\"”»)") and not _TRACE.match(_ANSI.sub("", bare)) and sum(c.isdigit() for c in bare) < 0.08 * len(bare)


def prose(text: str | None) -> str:
    """A notebook's own prose: its Markdown text, whatever form it is rendered in. Empty where there is none."""
    if not text or text.isspace():
        return ""
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    head = text.lstrip()
    if head.startswith("{"):
        try:
            book = json.loads(head, strict=False)
            cells = book.get("cells") or [c for s in book.get("worksheets") or [] for c in s.get("cells", [])]
            parts = []
            for c in cells:
                if c.get("cell_type") == "markdown":
                    source = c.get("source") or ""
                    parts.append(source if isinstance(source, str) else "".join(map(str, source)))
            return _markdown("\n\n".join(parts).replace("\r\n", "\n"))
        except (ValueError, AttributeError, TypeError):
            if '"cells"' in head[:200]:
                return ""
    lines = text.split("\n")
    if any(line.startswith(("# %%", "#%%")) for line in lines):
        parts, inside = [], False
        for line in lines:
            if m := _CELL.match(line):
                inside = "[markdown]" in m[1] or "[md]" in m[1]
                parts.append("")
            elif inside and line.startswith("#"):
                parts.append(line[2:] if line.startswith("# ") else line[1:])
            elif inside and line.strip():
                inside = False
        return _markdown("\n".join(parts))
    if any(_PROMPT.match(line) for line in lines):
        blocks: list[list[str]] = [[]]
        code = False
        for line in lines:
            if _PROMPT.match(line) or line.startswith("   ...:"):
                code = True
            elif not line.strip():
                code = False
                blocks.append([])
            elif not code:
                blocks[-1].append(line)
        # printed output stands between the cells without a mark; connected prose ends in a full stop and isn't made of figures
        return _markdown("\n\n".join(x for b in blocks if _connected(x := "\n".join(b))))
    return _markdown(text)


NAMES = ("sentence", "longest", "word", "long_words", "very_long", "diversity", "connectives", "depth", "commas", "amount", "rarity", "rare", "grade", "grade_high")
#: The first features need the document only.
OWN = 10
#: Bits from which a word is called rare, and parts into which the judged documents are split for the grades of their own words.
RARE, FOLDS = 12, 5


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def split(text: str) -> tuple[list[float], list[str], list[int], list[int], list[int]] | None:
    """The first OWN features, the distinct words in order of their first place, how often each occurs, the words in order as places in that list, and the words in each sentence. None without words."""
    sentences = [w for s in _STOP.split(text) if (w := words_of(s))]
    flat = [w for s in sentences for w in s]
    n, k = len(flat), len(sentences)
    if n == 0:
        return None
    place: dict[str, int] = {}
    ids = [place.setdefault(w, len(place)) for w in flat]
    counts = np.bincount(ids).tolist()
    lengths = [len(s) for s in sentences]
    sized = [(len(w), c) for w, c in zip(place, counts)]
    ties = sum(c for w, c in zip(place, counts) if w in CONNECTIVES)
    breaks = text.count(",") + text.count(";") + text.count(":")
    own = [
        math.log(n / k), math.log(max(lengths)), sum(x * c for x, c in sized) / n, sum(c for x, c in sized if x >= 10) / n, sum(c for x, c in sized if x >= 14) / n,
        len(place) / math.sqrt(2 * n), ties / n, ties / k, breaks / k, math.log(n),
    ]
    return own, list(place), counts, ids, lengths


@dataclass(frozen=True)
class Words:
    """What is known of words: rarity in bits (nan: not in the table) and the grade in the judged texts, a column for each fold left out and one for all; ``middle`` for words without one."""

    place: dict[str, int]
    rarity: np.ndarray
    grade: np.ndarray
    middle: float


def measure(words: pa.ListArray, ids: pa.ListArray, lengths: pa.ListArray, fold: np.ndarray, known: Words) -> list[np.ndarray]:
    """For each document its words, the sum of the rarity of those in the table, how many of these are rare, the mean grade of its sentences and their upper quartile; ``fold`` is the column of grades."""
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, ids, lengths)]
    begin = [np.cumsum(n) - n for n in sizes]
    code = words.flatten().dictionary_encode()
    place = np.array([known.place.get(w, -1) for w in code.dictionary.to_pylist()], np.int64)
    place = np.append(place[code.indices.to_numpy()], -1)
    at = place[np.repeat(begin[0], sizes[1]) + ids.flatten().to_numpy()]
    rarity = np.append(known.rarity, np.nan)[at]
    grade = np.vstack([known.grade, np.full((1, known.grade.shape[1]), known.middle)])[at, np.repeat(fold, sizes[1])]
    long = lengths.flatten().to_numpy().astype(np.int64)
    sentence = np.add.reduceat(grade, np.cumsum(long) - long) / long
    order = np.lexsort((sentence, np.repeat(np.arange(len(words)), sizes[2])))
    total = lambda x: np.add.reduceat(x, begin[1])
    return [sizes[1], total(np.nan_to_num(rarity)), total((rarity > RARE).astype(np.int64)), np.add.reduceat(sentence, begin[2]) / sizes[2], sentence[order][begin[2] + 3 * sizes[2] // 4]]


@dataclass(frozen=True)
class Ordinal:
    """Proportional odds: P(level > k) = sigmoid(x.b - cut[k])."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(level >= 2) and P(level >= 3)."""
        z = ((x - self.mean) / self.scale) @ self.weight
        return 1 / (1 + np.exp(-(z[:, None] - self.cuts[None, :])))


def fit_ordinal(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 400) -> Ordinal:
    """Levels ``y`` of 1, 2, 3; L2 penalty on the weights; Adam steps on the proportional-odds likelihood."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    n, d = z.shape
    share = np.clip([(y >= 2).mean(), (y >= 3).mean()], 1e-3, 1 - 1e-3)
    theta = np.concatenate([np.zeros(d), -np.log(share / (1 - share))])
    if theta[d + 1] <= theta[d]:
        theta[d + 1] = theta[d] + 1e-2
    m = np.zeros_like(theta)
    v = np.zeros_like(theta)
    for t in range(1, steps + 1):
        s = z @ theta[:d]
        p2, p3 = (1 / (1 + np.exp(-np.clip(s - c, -30, 30))) for c in theta[d:])
        probability = np.clip(np.where(y == 1, 1 - p2, np.where(y == 2, p2 - p3, p3)), 1e-9, 1)
        g2, g3 = p2 * (1 - p2), p3 * (1 - p3)
        ds = np.where(y == 1, -g2, np.where(y == 2, g2 - g3, g3)) / probability
        dc2 = np.where(y == 1, g2, np.where(y == 2, -g2, 0)) / probability
        dc3 = np.where(y == 2, g3, np.where(y == 3, -g3, 0)) / probability
        grad = -np.concatenate([z.T @ ds - penalty * theta[:d], [dc2.sum(), dc3.sum()]]) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        if theta[d + 1] < theta[d] + 1e-3:
            theta[d + 1] = theta[d] + 1e-3
    return Ordinal(mean, scale, theta[:d], theta[d:])


def extract(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, own, words, counts, ids, lengths`` of each document with prose: what :func:`split` gives."""
    schema = T.StructType([df.schema[key], *T._parse_datatype_string("own array<double>, words array<string>, counts array<int>, ids array<int>, lengths array<int>").fields])
    kinds = [pa.list_(pa.float64()), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [split(prose(t)) for t in part.column(1).to_pylist()]
                keep = pa.array([f is not None for f in found])
                columns = zip(*(f for f in found if f is not None)) if any(f is not None for f in found) else [[]] * 5
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), *(pa.array(list(c), kind) for c, kind in zip(columns, kinds))], names=schema.names)

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)


def each_word(stored: DataFrame, *keep: str) -> DataFrame:
    """``keep..., word, n`` of each document's distinct words."""
    return stored.select(*keep, F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))


def lexicon(judged: DataFrame, most: int, least: int = 3) -> list[tuple[str, list[int], list[float]]]:
    """Of each word in at least ``least`` judged documents (``words, fold, level``), at most the ``most`` most frequent: in how many of each fold it occurs and the sum of their levels."""
    in_fold = [F.col("fold") == k for k in range(FOLDS)]
    x = judged.select(F.explode("words").alias("word"), "fold", "level").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.array(*(F.count_if(f) for f in in_fold)).alias("ns"), F.array(*(F.coalesce(F.sum(F.when(f, F.col("level"))), F.lit(0.0)) for f in in_fold)).alias("sums")
    )
    return [(r["word"], r["ns"], r["sums"]) for r in x.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()]


def graded(entries: list[tuple[str, list[int], list[float]]], levels: np.ndarray, folds: np.ndarray, least: int = 3) -> np.ndarray:
    """Grades of the words: the mean level of the judged texts with it, drawn to the overall mean, without each fold and (last column) with all. A word in fewer than ``least`` texts has the overall mean."""
    n = np.array([e[1] for e in entries], float).reshape(-1, FOLDS)
    total = np.array([e[2] for e in entries], float).reshape(-1, FOLDS)
    out = np.empty((len(entries), FOLDS + 1))
    for k in range(FOLDS + 1):
        used = np.arange(FOLDS) != k
        others = levels[folds != k]
        mean = others.mean() if len(others) else levels.mean()
        count = n[:, used].sum(1)
        out[:, k] = np.where(count >= least, (total[:, used].sum(1) + 2 * mean) / (count + 2), levels.mean())
    return out


def vectors(stored: DataFrame, counted: DataFrame, common: DataFrame, total: int, known: Words, key: str, fold: Column, *keep: str) -> DataFrame:
    """``key, keep..., x ARRAY<DOUBLE>``: the values of NAMES of each stored document. Words outside the table are met by their own counts over all prose, in a join by word."""
    sent = stored.sparkSession.sparkContext.broadcast(known)
    fields = [*(stored.schema[c] for c in ("_row", key, "own", *keep)), *T._parse_datatype_string("size bigint, bits double, rare bigint, grade double, grade_high double").fields]
    n = 3 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                found = measure(*part.columns[n : n + 3], part.column(n + 3).to_numpy(), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *map(pa.array, found)], names=[f.name for f in fields])

    measured = stored.select("_row", key, "own", *keep, "words", "ids", "lengths", fold.cast("int").alias("_fold")).mapInArrow(run, T.StructType(fields))
    bits = F.log2(F.lit(float(total)) / F.col("n_all"))
    tail = each_word(stored, "_row").join(F.broadcast(common.select("word")), "word", "left_anti").join(counted.select("word", F.col("n").alias("n_all")), "word")
    tail = tail.groupBy("_row").agg(F.sum(F.col("n") * bits).alias("tail_bits"), F.sum(F.when(bits > RARE, F.col("n")).otherwise(0)).alias("tail_rare"))
    both = measured.join(tail, "_row", "left")
    share = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))) / F.col("size")
    return both.select(key, *keep, F.concat("own", F.array(share("bits", "tail_bits"), share("rare", "tail_rare"), F.col("grade"), F.col("grade_high"))).alias("x"))


def reading_levels(df: DataFrame, judged: DataFrame, key: str, text: str, level: str, most_labelled: int = MOST_LABELLED, lexicon_words: int = LEXICON_WORDS, table_words: int = TABLE_WORDS) -> DataFrame:
    """``key, level INT (1 easy, 2 ordinary, 3 demanding), score DOUBLE, p_demanding DOUBLE`` of each document with prose.

    * A document without prose - null, empty, only code - has no row. Texts are taken whole. Repeated documents each have a row. An empty table gives no rows; columns not named aren't read.
    * ``judged`` has ``key, level`` with levels 1 to 3; null levels don't count. A document judged more than once counts with the mean, rounded. Without any judged document that has prose, level, score and p_demanding are null.
    * The model is fitted on at most ``most_labelled`` judged documents, those with the smallest hash of the key, and its lexicon has at most ``lexicon_words`` words; only the feature vectors come to the driver.
    * Every word of the corpus has its own rarity, from its count over all prose; ``table_words`` only says for how many of them it is sent to the tasks.
    """
    stored = Written(extract(df, key, text).withColumn("_row", F.monotonically_increasing_id()), "prose").df
    counted = Written(each_word(stored).groupBy("word").agg(F.sum("n").alias("n")), "words").df
    common = Written(counted.orderBy(F.desc("n"), "word").limit(table_words), "common").df
    total = counted.agg(F.sum("n")).first()[0] or 0
    grades = judged.where(F.col(level).between(1, 3) & F.col(key).isNotNull()).groupBy(key).agg(F.floor(F.avg(level) + 0.5).cast("double").alias("level")).orderBy(F.xxhash64(key), key).limit(most_labelled)
    known = Written(stored.join(F.broadcast(grades), key).withColumn("fold", F.pmod(F.xxhash64(key, F.lit(5)), F.lit(FOLDS)).cast("int")), "judged")
    if not known.rows:
        return stored.select(key, F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("p_demanding"))
    labels = known.df.select("level", "fold").toPandas()
    levels, folds = labels["level"].to_numpy(), labels["fold"].to_numpy()
    entries = lexicon(known.df, lexicon_words)
    table = {r["word"]: math.log2(total / r["n"]) for r in common.collect()}
    place = {w: i for i, w in enumerate(dict.fromkeys([*(e[0] for e in entries), *table]))}
    grade = np.full((len(place), FOLDS + 1), levels.mean())
    grade[: len(entries)] = graded(entries, levels, folds)
    words = Words(place, np.array([table.get(w, np.nan) for w in place]), grade, float(levels.mean()))
    fitted = vectors(known.df, counted, common, total, words, key, F.col("fold"), "level").orderBy(key, "level", "x").collect()
    model = fit_ordinal(np.array([r["x"] for r in fitted]), np.array([r["level"] for r in fitted]))

    slope, at = model.weight / model.scale, float((model.mean / model.scale) @ model.weight)
    z = sum((F.col("x")[i] * F.lit(float(w)) for i, w in enumerate(slope)), F.lit(-at))
    above = [1 / (1 + F.exp(F.lit(float(c)) - z)) for c in model.cuts]
    scored = vectors(stored, counted, common, total, words, key, F.lit(FOLDS)).select(key, above[0].alias("p2"), above[1].alias("p3"))
    return scored.select(key, (F.lit(1) + (F.col("p2") >= 0.5).cast("int") + (F.col("p3") >= 0.5).cast("int")).alias("level"), (1 + F.col("p2") + F.col("p3")).alias("score"), F.col("p3").alias("p_demanding"))
