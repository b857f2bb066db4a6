"""Quality classifier by co-training of two views of a page.

One logistic classifier sees the text's content (hashed words and shape
counts), the other the page's metadata (source, language, length).  In each
round every classifier labels, of all unlabelled pages, the ones that it is
surest of for the other one, as many of each class as the class has among the
labelled pages.  A round stays only if the log-loss on labelled pages kept
aside falls.  Both are calibrated on those pages, and their log-odds add up to
the score of every page.

The classifiers are fitted on a bounded sample of labelled pages
(``PER_CLASS`` of each class, by hashed id) and on what they teach each other;
the unlabelled pages are all scored in every round, and a task hands on no more
than the pages that can be taught.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from churnkit.llm.textkit import LOWER, SPACE, hash_sample, slices, utf8, word_bounds, word_hashes

WORD_SLOTS = 512
SHAPES = 10
META = 1 + 64 + 32 + 3
PER_CLASS = 1500
ROUNDS = 4
PER_ROUND = 1.0
MOST_TAUGHT = 200

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>@=+~^\\_{}[]"]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"):ord("9") + 1] = True


def text_view(column) -> np.ndarray:
    """Per text: WORD_SLOTS hashed word shares and SHAPES shape figures, all about 0 to 1."""
    buf, offsets = utf8(column)
    n = len(offsets) - 1
    starts, ends, doc = word_bounds(buf, offsets, SPACE)
    h = word_hashes(LOWER[buf], starts, ends)
    slot = (h >> np.uint64(64 - 9)).astype(np.int64)
    words = np.bincount(doc * WORD_SLOTS + slot, minlength=n * WORD_SLOTS).reshape(n, WORD_SLOTS)
    n_words = np.maximum(words.sum(1), 1)
    n_bytes = np.maximum(np.diff(offsets), 1)

    def share(table):
        c = np.concatenate([[0], np.cumsum(table[buf])])
        return (c[offsets[1:]] - c[offsets[:-1]]) / n_bytes

    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], weights=fresh, minlength=n)
    newline = np.zeros(256, bool)
    newline[ord("\n")] = True
    shapes = np.stack([
        np.log1p(n_words) / 10, (n_bytes / n_words).clip(0, 40) / 40, share(_SYMBOLS).clip(0, 0.5) * 2,
        share(_UPPER), share(_DIGIT), (share(_STOPS) * 10).clip(0, 1), (share(newline) * 10).clip(0, 1),
        distinct / n_words, (n_words < 50).astype(float), (np.diff(offsets) == 0).astype(float)], axis=1)
    return np.concatenate([np.sqrt(words / n_words[:, None]), shapes], axis=1).astype(np.float32)


def meta_view(source, lang, n_chars) -> np.ndarray:
    """Per page: the source and the language as hashed indicators, the length on a log scale; nulls have their own slots."""
    out = np.zeros((len(n_chars), META), np.float32)
    for i, (s, v, n) in enumerate(zip(source, lang, n_chars)):
        out[i, 0 if s is None else 1 + xxhash.xxh3_64_intdigest(str(s)) % 64] = 1
        out[i, 65 + (0 if v is None else 1 + xxhash.xxh3_64_intdigest(str(v)) % 31)] = 1
        size = np.log1p(max(0, n)) / 12 if n is not None else 0.0
        out[i, 97:] = size, size * size, n is None
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 200) -> Logistic:
        """Balanced classes, accelerated gradient steps."""
        share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
        w, b = np.zeros(x.shape[1]), 0.0
        vw, vb, t = w, b, 1.0
        step = 1 / (ridge + 0.25 * (1 + float((x * x).sum(1).max(initial=0))))
        for _ in range(rounds):
            miss = (_sigmoid(x @ vw + vb) - y) * share
            nw, nb = vw - step * (miss @ x + ridge * vw), vb - step * float(miss.sum())
            t2 = (1 + float(np.sqrt(1 + 4 * t * t))) / 2
            vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
            w, b, t = nw, nb, t2
        return Logistic(w, b)

    def margin(self, x):
        return x @ self.weight + self.bias

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """Platt scaling by Newton steps that never raise the loss, on smoothed targets."""
        if len(set(y.tolist())) < 2:
            return self
        z, pos, neg = self.margin(x), (y > 0).sum(), (y == 0).sum()
        target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        def loss(a, b):
            f = a * z + b
            return float((np.logaddexp(0, f) - target * f).sum() + 1e-3 * a * a)

        a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
        now = loss(a, b)
        for _ in range(100):
            p = _sigmoid(a * z + b)
            v = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((p - target) * z).sum() + 2e-3 * a, (p - target).sum()])
            hess = np.array([[(v * z * z).sum() + 2e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
            step, size = np.linalg.solve(hess, g), 1.0
            while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
                size /= 2
            a, b = a - size * step[0], b - size * step[1]
            before, now = now, loss(a, b)
            if before - now < 1e-9:
                break
        self.slope, self.shift = max(0.0, float(a)), float(b)
        return self

    def log_odds(self, x):
        return self.slope * self.margin(x) + self.shift


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    prior: float

    def score(self, xt, xm):
        """(content, metadata, combined) probabilities of good quality."""
        a, b = self.text.log_odds(xt), self.meta.log_odds(xm)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def log_loss(model: CoTrained, xt, xm, y) -> float:
    p = np.clip(model.score(xt, xm)[2], 1e-9, 1 - 1e-9)
    return float(-np.mean(np.where(y > 0, np.log(p), np.log(1 - p))))


# what a view teaches: per view and class the content and metadata features of the pages it is surest of
Taught = dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]


def from_arrays(pool_t: np.ndarray, pool_m: np.ndarray) -> Callable[[CoTrained, dict[int, int]], Taught]:
    """Teaching from pages that are held as arrays; a page is taught once by each view."""
    left = {v: np.arange(len(pool_t)) for v in ("t", "m")}

    def teach(model, most):
        out = {}
        for v, x, classifier in (("t", pool_t, model.text), ("m", pool_m, model.meta)):
            order = left[v][np.argsort(classifier.margin(x[left[v]]), kind="stable")]
            chosen = {0: order[:most[0]], 1: order[len(order) - min(most[1], max(0, len(order) - most[0])):]}
            out |= {(v, c): (pool_t[rows], pool_m[rows]) for c, rows in chosen.items()}
            left[v] = np.setdiff1d(left[v], np.concatenate([chosen[0], chosen[1]]))
        return out

    return teach


def co_train(xt, xm, y, pool_t, pool_m, aside, rounds: int = ROUNDS, per_round: float = PER_ROUND) -> CoTrained | None:
    """Co-training on pages held as arrays; see :func:`train`."""
    return train(xt, xm, y, aside, from_arrays(pool_t, pool_m), rounds, per_round)


def train(xt, xm, y, aside, teach: Callable[[CoTrained, dict[int, int]], Taught], rounds: int = ROUNDS,
          per_round: float = PER_ROUND) -> CoTrained | None:
    """Fit both views on the labelled rows not ``aside`` and on what each teaches the other; calibrate on those aside.

    A round teaches ``per_round`` times the labelled rows, in the proportion of their classes, and stays if the
    log-loss of the rows aside falls; the first one that does not ends the training.
    """
    if len(set(y[~aside].tolist())) < 2:
        return None
    rows = aside if len(set(y[aside].tolist())) == 2 else np.ones(len(y), bool)
    # of the rows that both calibrations saw, so that a view without a say adds nothing
    prior = float(np.log(((y[rows] > 0).sum() + 1) / ((y[rows] == 0).sum() + 1)))
    own = y[~aside]
    known = {"t": [(xt[~aside], own)], "m": [(xm[~aside], own)]}

    def fitted(examples):
        t, m = (Logistic.fit(np.concatenate([x for x, _ in examples[v]]), np.concatenate([c for _, c in examples[v]])) for v in ("t", "m"))
        return CoTrained(t.calibrate(xt[rows], y[rows]), m.calibrate(xm[rows], y[rows]), prior)

    model = fitted(known)
    loss = log_loss(model, xt[rows], xm[rows], y[rows])
    most = {c: min(MOST_TAUGHT, max(1, round(per_round * int((own == c).sum())))) for c in (0, 1)}
    for _ in range(rounds):
        more = {"t": [], "m": []}
        for (view, label), (content, meta) in teach(model, most).items():
            other, x = ("m", meta) if view == "t" else ("t", content)
            more[other].append((x, np.full(len(x), float(label))))
        if not sum(len(c) for part in more.values() for _, c in part):
            break
        trial = {v: known[v] + more[v] for v in known}
        new = fitted(trial)
        now = log_loss(new, xt[rows], xm[rows], y[rows])
        if now >= loss:
            break
        model, loss, known = new, now, trial
    return model


def _pages(df: DataFrame, id_col, text_col, source_col, lang_col, size_col) -> DataFrame:
    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"), df[source_col].cast("string").alias("source"),
                     df[lang_col].cast("string").alias("lang"), df[size_col].cast("bigint").alias("n_chars"))


def _views(s: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(s.column("text")), meta_view(*(s.column(c).to_pylist() for c in ("source", "lang", "n_chars")))


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both views, label and the fold of a bounded sample, in a fixed order."""
    def run(batches):
        for b in batches:
            for s in slices(b):
                xt, xm = _views(s)
                yield pa.RecordBatch.from_arrays(
                    [s.column("fold"), s.column("label"), pa.array([r.tobytes() for r in xt.astype(np.float16)], pa.binary()),
                     pa.array([r.tobytes() for r in xm.astype(np.float16)], pa.binary())], ["fold", "label", "xt", "xm"])

    got = rows.mapInArrow(run, "fold int, label double, xt binary, xm binary").toArrow()
    got = got.sort_by([("fold", "ascending"), ("xt", "ascending"), ("xm", "ascending")])
    view = lambda c, d: np.frombuffer(b"".join(got[c].to_pylist()), np.float16).reshape(-1, d).astype(np.float64)
    return view("xt", WORD_SLOTS + SHAPES), view("xm", META), got["label"].to_numpy(), got["fold"].to_numpy()


def from_pages(pages: DataFrame) -> Callable[[CoTrained, dict[int, int]], Taught]:
    """Teaching from a table of unlabelled pages: every page is scored, and per view and class the surest ones come
    back.  A task keeps no more than these of the pages it has seen; equal margins go by a hash of the page."""
    taught: dict[str, set[int]] = {"t": set(), "m": set()}

    def teach(model, most):
        def surest(batches):
            best = {(v, c): [] for v in ("t", "m") for c in (0, 1)}
            for b in batches:
                for s in slices(b):
                    xt, xm = _views(s)
                    page = s.column("page").to_numpy()
                    for v, margin in (("t", model.text.margin(xt)), ("m", model.meta.margin(xm))):
                        left = np.flatnonzero(~np.isin(page, np.fromiter(taught[v], np.int64, len(taught[v]))))
                        for c in (0, 1):
                            value = -margin[left] if c else margin[left]
                            for i in np.lexsort((page[left], value))[:most[c]]:
                                j = left[i]
                                best[v, c].append((float(value[i]), int(page[j]), xt[j].astype(np.float16).tobytes(), xm[j].astype(np.float16).tobytes()))
                            best[v, c] = sorted(best[v, c])[:most[c]]
            rows = [(v, c, *r) for (v, c), some in best.items() for r in some]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), (
                    pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.binary()))], ["view", "class", "value", "page", "xt", "xm"])

        found = pages.mapInArrow(surest, "view string, class int, value double, page bigint, xt binary, xm binary")
        order = Window.partitionBy("view", "class").orderBy("value", "page", "xt")
        top = max(most.values())
        got = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).toArrow()  # 4 x MOST_TAUGHT rows at most
        out = {}
        for v, other in (("t", "m"), ("m", "t")):
            for c in (0, 1):
                part = sorted((r for r in got.to_pylist() if r["view"] == v and r["class"] == c), key=lambda r: r["r"])[:most[c]]
                taught[v] |= {r["page"] for r in part}
                out[v, c] = tuple(np.frombuffer(b"".join(r[k] for r in part), np.float16).reshape(len(part), -1 if part else d).astype(np.float64)
                                  for k, d in (("xt", WORD_SLOTS + SHAPES), ("xm", META)))
        return out

    return teach


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                lang_col: str = "lang", size_col: str = "n_chars", label_id_col: str = "doc_id", label_col: str = "quality",
                per_class: int = PER_CLASS, rounds: int = ROUNDS) -> CoTrained | None:
    """None where the labelled sample does not hold both classes.

    Of the rows of one labelled id the first in the order of their columns counts; rows with a null id and without a
    label are unlabelled pages.
    """
    pages = _pages(df, id_col, text_col, source_col, lang_col, size_col)
    # repeated labels of a page count once; a page labelled both ways counts as poor
    known = (labels.where(labels[label_id_col].isNotNull() & labels[label_col].isNotNull())
             .groupBy(labels[label_id_col].alias("id")).agg(F.min(labels[label_col].cast("double")).alias("label")))
    sample = known.where(hash_sample(known, "id", per_class, "label"))  # at most per_class rows of each class
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int")
    # one row of each sampled id, however often it is repeated
    whole = pages.join(F.broadcast(sample), pages.doc_id == F.col("id")).groupBy("doc_id").agg(
        F.min(F.struct("text", "source", "lang", "n_chars", "label")).alias("p")).select("doc_id", "p.*")
    xt, xm, y, folds = _collected(whole.withColumn("fold", fold))
    if not len(y):
        return None
    page = F.xxhash64("doc_id", "text", "source", "lang", "n_chars").alias("page")
    rest = pages.join(F.broadcast(sample.select("id")), pages.doc_id == F.col("id"), "left_anti").select("*", page)
    return train(xt, xm, y, folds == 0, from_pages(rest), rounds)


def score_quality(df: DataFrame, model: CoTrained | None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  lang_col: str = "lang", size_col: str = "n_chars", least: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, score and kept (score of at least ``least``) for every row.

    Nulls of any column have features of their own.  Without a model all
    probabilities are 0.5.  Repeated rows are kept as they come.
    """
    pages = _pages(df, id_col, text_col, source_col, lang_col, size_col)

    def run(batches):
        for b in batches:
            for s in slices(b):
                if model is None:
                    p = [np.full(s.num_rows, 0.5)] * 3
                else:
                    p = model.score(*_views(s))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), *(pa.array(x.astype(np.float64)) for x in p), pa.array(p[2] >= least)],
                                                 ["doc_id", "p_text", "p_meta", "score", "kept"])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"doc_id {kind}, p_text double, p_meta double, score double, kept boolean")
