"""Language identification in two steps: the family first, then the language within it.

Features are hashed byte n-grams (2 to 4) of the lower-cased text with
everything but letters turned into blanks; square roots of counts, scaled to
unit length.  One-versus-one linear support vector machines (squared hinge)
separate the families, and others separate the languages inside each family;
the most votes win, margins break ties.

The model is fitted on all labelled rows.  They are dealt by a hash into parts
of bounded size, each task fits the machines of a part, and a machine's weights
are the mean over the parts.  A rare language lends its rows to several parts,
so that no part lacks it.  Whole texts are scored, in one pass without a
shuffle.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnkit.llm.textkit import slices, utf8
from churnkit.session import reliable

BITS = 12
DIM = 1 << BITS
ORDERS = (2, 3, 4)
ROWS_AT_ONCE = 256
PER_LANG = 1200
PART_LANGS = 2
LEAST_ROWS = 200
CONVERTED_AT_ONCE = 512
BINS = 4096
SCORE_SLOPE = 4.0
REJECT_QUANTILE = 0.001
FOLDS = 3
UNDETERMINED = "und"

# Families of common languages by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "semitic": ("ar", "he", "mt", "am"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
    "sinitic": ("zh", "yue"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "uralic": ("fi", "et", "hu"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[ord("A"):ord("Z") + 1] += 32
for _c in range(128):
    if not chr(_c).isalpha():
        _BLANKED[_c] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per document of DIM scaled n-gram counts."""
    n_docs, n = len(offsets) - 1, len(buf)
    counts = np.zeros(n_docs * DIM, np.float64)
    if n:
        b = _BLANKED[buf].astype(np.uint32)
        doc = np.repeat(np.arange(n_docs), np.diff(offsets))
        gram = b.copy()
        for k in range(2, max(ORDERS) + 1):
            m = n - k + 1
            if m <= 0:
                break
            gram = gram[:m] | (b[k - 1:] << np.uint32(8 * (k - 1)))
            if k not in ORDERS:
                continue
            slot = ((gram ^ np.uint32(k * 0x01000193)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            whole = doc[:m] == doc[k - 1:]
            counts += np.bincount((doc[:m] * DIM + slot)[whole], minlength=n_docs * DIM)
    x = np.sqrt(counts).astype(np.float32).reshape(n_docs, DIM)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def feature_blocks(buf: np.ndarray, offsets: np.ndarray, rows: int = ROWS_AT_ONCE):
    """(first document, features) of ``rows`` documents at a time: the memory does not depend on how short texts are."""
    for s in range(0, len(offsets) - 1, rows):
        part = offsets[s:s + rows + 1]
        yield s, features(buf[part[0]:part[-1]], part - part[0])


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss for y in {-1, 1}: accelerated full-gradient steps."""
    n = len(y)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb, t = w.copy(), b, 1.0
    step = 1.0 / (1.0 / c + 4.0)
    for _ in range(rounds if n else 0):
        slack = np.maximum(0.0, 1.0 - y * (x @ vw + vb)) * share * 2.0 * y
        nw, nb = vw - step * (vw / c - slack @ x), vb + step * float(slack.sum())
        t2 = (1 + float(np.sqrt(1 + 4 * t * t))) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return w.astype(np.float32), float(b)


@dataclass
class Node:
    """One-versus-one machines over ``names``; row p of ``weight`` is the machine of pair p."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weight: np.ndarray | None = None
    bias: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Node:
        """``y``: positions in ``names``; rows of any other value are left out."""
        ws, bs = [], []
        for i, j in combinations(range(len(self.names)), 2):
            rows = np.flatnonzero((y == i) | (y == j))
            # only the rows of one pair are held in full precision
            some = np.empty((len(rows), x.shape[1]), np.float32)
            for s in range(0, len(rows), CONVERTED_AT_ONCE):
                some[s:s + CONVERTED_AT_ONCE] = x[rows[s:s + CONVERTED_AT_ONCE]]
            w, b = fit_svm(some, np.where(y[rows] == i, 1.0, -1.0).astype(np.float32))
            self.pairs.append((i, j))
            ws.append(w)
            bs.append(b)
        if ws:
            self.weight, self.bias = np.stack(ws), np.array(bs, np.float32)
        return self

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner per row and its confidence: the mean squashed margin over the pairs it takes part in."""
        n, k = len(x), len(self.names)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        margin = x @ self.weight.T + self.bias
        votes, sure = np.zeros((n, k)), np.zeros((n, k))
        for p, (i, j) in enumerate(self.pairs):
            squashed = 1 / (1 + np.exp(-SCORE_SLOPE * margin[:, p].astype(np.float64)))
            votes[:, i] += margin[:, p] > 0
            votes[:, j] += margin[:, p] <= 0
            sure[:, i] += squashed
            sure[:, j] += 1 - squashed
        sure /= k - 1
        best = (votes + sure / 2).argmax(1)
        return best, sure[np.arange(n), best]


@dataclass
class LanguageModel:
    family: Node
    within: dict[str, Node]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        chosen, sure = self.family.decide(x)
        lang, score = np.empty(len(x), object), np.zeros(len(x))
        for i, name in enumerate(self.family.names):
            rows = np.flatnonzero(chosen == i)
            if len(rows):
                node = self.within[name]
                best, inner = node.decide(x[rows])
                lang[rows] = np.array(node.names, object)[best]
                score[rows] = sure[rows] * inner
        return list(lang), score


def labelled_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return (df.select(df[id_col].cast("string").alias("id"), df[text_col].cast("string").alias("text"),
                      df[lang_col].cast("string").alias("lang"))
            .where(F.col("lang").isNotNull() & F.col("text").isNotNull()))


def dealt(rows: DataFrame, per_lang: int = PER_LANG, least: int = LEAST_ROWS) -> tuple[DataFrame, int]:
    """(part, lang, text) of all labelled rows and the number of parts: some ``PART_LANGS * per_lang`` rows each.

    A hash of id and text deals a language's rows into as many groups as there are parts, or into fewer that have some
    ``least`` rows each; part p takes group p modulo their number.  So a row of a rare language is in several parts.
    """
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    parts = max(1, -(-sum(counts.values()) // (PART_LANGS * per_lang)))
    groups = rows.sparkSession.createDataFrame([(lang, min(parts, max(1, n // least))) for lang, n in counts.items()],
                                               "in_lang string, n_groups int")
    out = rows.join(F.broadcast(groups), F.col("lang") == F.col("in_lang")).withColumn(
        "group", F.pmod(F.xxhash64("id", "text"), F.col("n_groups")).cast("int"))
    return out.select(F.explode(F.sequence("group", F.lit(parts - 1), "n_groups")).alias("part"), "lang", "text"), parts


def text_fold(row: np.ndarray, folds: int) -> int:
    """Equal texts share a fold.  ``row``: features in half precision."""
    return zlib.crc32(row.tobytes()) % folds


def fit_nodes(x: np.ndarray, langs: list[str], use: np.ndarray | None = None) -> LanguageModel | None:
    """``use``: whether each row is learned from (default: all are)."""
    names = sorted({v for i, v in enumerate(langs) if use is None or use[i]})
    if not names:
        return None

    def places(place):
        return np.array([place.get(v, -1) if use is None or use[i] else -1 for i, v in enumerate(langs)])

    families = families_of(names)
    top = Node(list(families)).fit(x, places({v: i for i, members in enumerate(families.values()) for v in members}))
    return LanguageModel(top, {f: Node(members).fit(x, places({v: i for i, v in enumerate(members)}))
                               for f, members in families.items()})


def families_of(names: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for v in sorted(names):
        out.setdefault(FAMILY_OF.get(v, f"only {v}"), []).append(v)
    return dict(sorted(out.items()))


def _part_machines(langs: list[str], x: np.ndarray, known: np.ndarray, folds: int):
    """(fold, family, a, b, weights and bias) of one part's machines: fold -1 learns from all rows, fold f from those
    that are not in it.  Machines between families have no family; a language that was seen is a row without weights."""
    order = []
    for v in sorted(set(langs)):  # the same order on every run
        order += sorted((i for i, w in enumerate(langs) if w == v), key=lambda i: (x[i].tobytes(), known[i]))
    langs, x = [langs[i] for i in order], x[order]
    fold = np.array([text_fold(r, folds) for r in x]) if folds else None
    for f in range(-1, folds):
        model = fit_nodes(x, langs, None if f < 0 else fold != f)
        if model is None:
            continue
        for family, node in [(None, model.family), *model.within.items()]:
            if family is not None:
                yield from ((f, family, v, None, []) for v in node.names)
            for p, (i, j) in enumerate(node.pairs):
                yield f, family, node.names[i], node.names[j], [*node.weight[p].tolist(), float(node.bias[p])]


def _fit_parts(folds: int):
    schema = pa.schema([("fold", pa.int32()), ("family", pa.string()), ("a", pa.string()), ("b", pa.string()),
                        ("values", pa.list_(pa.float64()))])

    def run(batches):
        part, langs, x, known = None, [], [], []

        def fitted():
            if langs:
                rows = list(_part_machines(langs, np.concatenate(x), np.concatenate(known), folds))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            at = b.column("part").to_numpy()
            ends = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for start, stop in zip(ends[:-1], ends[1:]):
                if stop == start:
                    continue
                if at[start] != part:
                    yield from fitted()
                    part, langs, x, known = at[start], [], [], []
                for s in slices(b.slice(start, stop - start)):
                    buf, offsets = utf8(s.column("text"))
                    known.append(has_letter(s.column("text"), buf, offsets))
                    langs += s.column("lang").to_pylist()
                    x += [block.astype(np.float16) for _, block in feature_blocks(buf, offsets)]
        yield from fitted()

    return run


def fit_parts(rows: DataFrame, per_lang: int, folds: int = 0) -> dict[int, LanguageModel]:
    """The model of all labelled rows (at -1) and those that leave out one fold each: means over the parts."""
    parted, n = dealt(rows, per_lang)
    machines = reliable(parted.repartition(n, "part").sortWithinPartitions("part").mapInArrow(
        _fit_parts(folds), "fold int, family string, a string, b string, values array<double>"))
    key = ["fold", "family", "a", "b"]
    # sums of single-precision numbers in double precision: the same in any order, but for the last bits
    means = machines.where("b is not null").select(*key, F.posexplode("values").alias("at", "v")).groupBy(*key, "at").agg(
        F.avg("v").alias("v")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("values"))
    found = {(r["fold"], r["family"], r["a"], r["b"]): np.array([v["v"] for v in r["values"]], np.float32)
             for r in means.toLocalIterator()}  # one row a machine
    seen: dict[int, list[str]] = {}
    for r in machines.where("b is null").select("fold", "a").distinct().collect():  # one row a fold and language
        seen.setdefault(r["fold"], []).append(r["a"])

    def node(fold, family, names):
        pairs = list(combinations(range(len(names)), 2))
        if not pairs:
            return Node(names)
        # languages that share no part have no machine
        got = np.stack([found.get((fold, family, names[i], names[j]), np.zeros(DIM + 1, np.float32)) for i, j in pairs])
        return Node(names, pairs, got[:, :DIM].copy(), got[:, DIM].copy())

    out = {}
    for fold, names in seen.items():
        families = families_of(names)
        out[fold] = LanguageModel(node(fold, None, list(families)), {f: node(fold, f, m) for f, m in families.items()})
    return out


def fit_language_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       per_lang: int = PER_LANG) -> LanguageModel | None:
    """Fit on all of ``df``'s labelled rows; None without any.  ``per_lang``: rows of a language in one of its parts,
    on average."""
    return fit_parts(labelled_rows(df, id_col, text_col, lang_col), per_lang).get(-1)


def right_scores(rows: DataFrame, models: dict[int, LanguageModel], folds: int = FOLDS) -> DataFrame:
    """(lang, score) of the labelled rows with letters that are predicted right by the model fitted without their fold."""
    def run(batches):
        for b in batches:
            for s in slices(b):
                buf, offsets = utf8(s.column("text"))
                known, langs = has_letter(s.column("text"), buf, offsets), s.column("lang").to_pylist()
                right, scores = [], []
                for at, block in feature_blocks(buf, offsets):
                    x = block.astype(np.float16)
                    fold = np.array([text_fold(r, folds) for r in x])
                    for f in range(folds):
                        some = np.flatnonzero((fold == f) & known[at:at + len(x)])
                        if f in models and len(some):
                            got = [(v, p) for i, v, p in zip(some, *models[f].predict(x[some].astype(np.float32)))
                                   if v == langs[at + i]]
                            right += [v for v, _ in got]
                            scores += [float(p) for _, p in got]
                yield pa.RecordBatch.from_arrays([pa.array(right, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, score double")


def lower_quantiles(scored: DataFrame, quantile: float) -> dict[str, float]:
    """Per language the ``quantile`` of all scores, the lower of two neighbours: exact, whatever the number of rows.

    Scores are counted in bins between the least and the greatest that are still in question; the bin that holds the
    wanted rank is looked into again until all its scores are equal.
    """
    ends = scored.groupBy("lang").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    todo = {r["lang"]: (r["lo"], r["hi"], int(quantile * (r["n"] - 1))) for r in ends}  # the rank counts from 0 at lo
    out = {}
    while True:
        out |= {v: lo for v, (lo, hi, _) in todo.items() if lo == hi}
        todo = {v: t for v, t in todo.items() if t[0] < t[1]}
        if not todo:
            return out
        near = scored.sparkSession.createDataFrame([(v, lo, hi) for v, (lo, hi, _) in todo.items()],
                                                   "in_lang string, lo double, hi double")
        place = F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins: dict[str, list] = {}
        for r in (scored.join(F.broadcast(near), (F.col("lang") == F.col("in_lang")) & F.col("score").between(F.col("lo"), F.col("hi")))
                  .groupBy("lang", place.alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
                  .collect()):  # at most BINS rows a language
            bins.setdefault(r["lang"], []).append((r["bin"], r["lo"], r["hi"], r["n"]))
        for v, (_, _, rank) in list(todo.items()):
            for _, lo, hi, n in sorted(bins[v]):
                if rank < n:
                    todo[v] = lo, hi, rank
                    break
                rank -= n


def fit_language_filter(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                        per_lang: int = PER_LANG, quantile: float = REJECT_QUANTILE,
                        folds: int = FOLDS) -> tuple[LanguageModel | None, dict[str, float]]:
    """The model and each language's least score for ``keep_languages``, both from all labelled rows: the ``quantile``
    of the scores that the language's rows reach out of fold where they are predicted right, 0 where none is.  A model
    of a single language has nothing to tell it from and rejects only texts without a letter."""
    rows = labelled_rows(df, id_col, text_col, lang_col)
    models = fit_parts(rows, per_lang, folds)
    if -1 not in models:
        return None, {}
    least = dict.fromkeys((v for node in models[-1].within.values() for v in node.names), 0.0)
    return models[-1], least | lower_quantiles(reliable(right_scores(rows, models, folds)), quantile)


def has_letter(column, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf], dtype=np.int64)])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(map(str.isalpha, column[int(i)].as_py() or ""))
    return out


def predict_batch(model: LanguageModel | None, column) -> tuple[list[str], np.ndarray]:
    buf, offsets = utf8(column)
    known = has_letter(column, buf, offsets)
    lang, score = [UNDETERMINED] * len(column), np.zeros(len(column))
    if model is not None and known.any():
        for at, x in feature_blocks(buf, offsets):
            got, sure = model.predict(x)
            for i in np.flatnonzero(known[at:at + len(x)]):
                lang[at + i], score[at + i] = got[i], sure[i]
    return lang, score


def predict_languages(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every row.

    Null texts and texts without a letter are ``und`` with score 0, as is
    everything when there was nothing to learn from.  Repeated rows and null
    ids are kept as they come.
    """
    docs = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))

    def run(batches):
        for b in batches:
            for s in slices(b):
                lang, score = predict_batch(model, s.column("text"))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)],
                                                 ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_languages(df: DataFrame, model: LanguageModel | None, accepted: tuple[str, ...] | None = None,
                   min_score: float | dict[str, float] = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose predicted language is accepted (default: any learned one) with
    a score of at least ``min_score`` (one for all, or one per language); undetermined texts go."""
    def least(lang):
        return min_score.get(lang, 0.0) if isinstance(min_score, dict) else min_score

    def run(batches):
        for b in batches:
            for s in slices(b, text_col):
                lang, score = predict_batch(model, s.column(text_col))
                keep = [v != UNDETERMINED and p >= least(v) and (accepted is None or v in accepted)
                        for v, p in zip(lang, score)]
                yield s.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
