"""Language identification in two steps: the language's family first, then one-versus-one linear SVMs within it.

Features are relative frequencies of hashed character n-grams (1 to 3) of the whole text, each scaled by the inverse
square root of its mean frequency. Family: linear SVMs, one for each family against the rest. Within a family each pair of
languages has an SVM of its own; the language that wins most pairs is predicted, ties going to the larger sum of margins.
The models are fitted on a bounded sample, at most ``sample`` rows for each language, chosen by a hash of the id. At
prediction every n-gram costs one row of a table with a column for each SVM.

Defined results: null texts, and texts without a letter, are ``und`` with score 0, as is everything without training rows;
with one learned language, that is predicted; a language missing in FAMILIES is a family of its own.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import runtime
from gridloom.llm.chargrams import Rows, fit, grams, groups, inside

# Branches of language families, by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
    "sinitic": ("zh", "zh-cn", "zh-tw", "yue"),
}
SIZES = (1, 2, 3)


def family(lang: str) -> str:
    return next((f for f, ls in FAMILIES.items() if lang.lower() in ls), lang)


def has_letter(t: str | None) -> bool:
    return bool(t) and (t.isalpha() or any(map(str.isalpha, t)))


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    tasks: list[tuple[str, str, str]]  # (family, rest marker or lang, lang): the SVM of each column
    weights: np.ndarray
    bias: np.ndarray
    bits: int

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        out, score = ["und"] * n, np.zeros(n)
        ok = [i for i in range(n) if has_letter(texts[i])]
        if not self.langs or not ok:
            return out, score
        z = np.tile(self.bias, (len(ok), 1))
        for first, cp, bounds in groups([texts[i] for i in ok]):
            if not len(self.tasks):
                continue
            total = np.zeros((len(bounds) - 1, len(self.tasks)))
            count = np.zeros(len(bounds) - 1)
            for m in SIZES:
                h = grams(cp, m, self.bits)
                keep = inside(bounds, m, len(h))
                v = self.weights[h]
                v[~keep] = 0
                total += np.add.reduceat(v, bounds[:-1], axis=0)
                count += np.maximum(0, np.diff(bounds) - m + 1)
            z[first : first + len(total)] += total / np.maximum(1, count)[:, None]
        col = {t: i for i, t in enumerate(self.tasks)}
        sig = 1 / (1 + np.exp(-np.clip(4 * z, -500, 500)))
        if len(self.families) > 1:
            fz = np.stack([z[:, col["family", "rest", f]] for f in self.families], 1)
            fs = np.stack([sig[:, col["family", "rest", f]] for f in self.families], 1)
            best, fam_score = fz.argmax(1), fs.max(1)
        else:
            best, fam_score = np.zeros(len(ok), int), np.ones(len(ok))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            members = [x for x in self.langs if family(x) == f]
            wins, margin = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            sure = np.ones((len(rows), len(members)))
            for a, b in itertools.combinations(range(len(members)), 2):
                c = col[f, members[a], members[b]]
                s, p = z[rows, c], sig[rows, c]
                wins[:, a] += s > 0
                wins[:, b] += s <= 0
                margin[:, a] += s
                margin[:, b] -= s
                sure[:, a] = np.minimum(sure[:, a], p)
                sure[:, b] = np.minimum(sure[:, b], 1 - p)
            pick = np.lexsort((margin, wins), axis=1)[:, -1] if len(rows) else np.zeros(0, int)
            for r, x in zip(rows.tolist(), pick.tolist(), strict=True):
                out[ok[r]] = members[x]
            score[np.array(ok, int)[rows]] = fam_score[rows] * sure[np.arange(len(rows)), pick]
        return out, score


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", bits: int = 14, sample: int = 500, penalty: float = 1e-4) -> Model:
    """Learn from the rows of docs with a language and a letter in the text."""
    spark = docs.sparkSession
    runtime.prepare(spark)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.lit(1.0)
    for name, n in counts.items():
        part = F.when(F.col(lang) == name, F.lit(min(1.0, sample / n))).otherwise(part)
    picked = rows.where(F.pmod(F.xxhash64(key, text), F.lit(1 << 30)) < part * (1 << 30)).select(F.col(lang).alias("l"), F.col(text).alias("t"))

    def kernel(it):
        for batch in it:
            texts, langs = batch.column("t").to_pylist(), batch.column("l").to_pylist()
            out = []
            for first, cp, bounds in groups(texts):
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    c = sum(np.bincount(grams(cp[a:b], m, bits), minlength=1 << bits) for m in SIZES)
                    at = np.flatnonzero(c)
                    if has_letter(texts[first + i]):
                        out.append((langs[first + i], at.astype(np.uint16).tobytes() if bits <= 16 else at.astype(np.uint32).tobytes(), (c[at] / c.sum()).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["l", "i", "v"])

    got = picked.mapInArrow(runtime.lean(kernel), "l string, i binary, v binary").collect()  # about `sample` rows for each language
    got.sort(key=lambda r: (r["l"], bytes(r["i"]), bytes(r["v"])))
    langs = sorted({r["l"] for r in got})
    width = 1 << bits
    cols = [np.frombuffer(bytes(r["i"]), np.uint16 if bits <= 16 else np.uint32).astype(np.int64) for r in got]
    vals = [np.frombuffer(bytes(r["v"]), np.float32).astype(float) for r in got]
    col, val = (np.concatenate(x) if x else np.zeros(0) for x in (cols, vals))
    row = np.repeat(np.arange(len(got)), [len(c) for c in cols])
    mean = np.bincount(col.astype(np.int64), val, minlength=width) / max(1, len(got))
    scale = 1 / np.sqrt(mean + 1e-6)
    x = Rows(row, col.astype(np.int64), val * scale[col.astype(np.int64)], len(got), width)
    y = np.array([r["l"] for r in got])
    fam = np.array([family(v) for v in y])
    families = sorted(set(fam.tolist()))
    tasks, weights, bias = [], [], []
    if len(families) > 1:
        for f in families:
            if len(families) == 2 and f == families[1]:  # two families: one line parts them
                w, b = -weights[0], -bias[0]
            else:
                w, b = fit(x, np.where(fam == f, 1.0, -1.0), "hinge", penalty, 80)
            tasks.append(("family", "rest", f))
            weights.append(w)
            bias.append(b)
    for f in families:
        for a, b in itertools.combinations([v for v in langs if family(v) == f], 2):
            keep = (y == a) | (y == b)
            w, c = fit(x.some(keep), np.where(y[keep] == a, 1.0, -1.0), "hinge", penalty, 80)
            tasks.append((f, a, b))
            weights.append(w)
            bias.append(c)
    table = (np.stack(weights, 1) * scale[:, None]).astype(np.float32) if tasks else np.zeros((width, 0), np.float32)
    return Model(langs, families, tasks, table, np.array(bias), bits)


def identify(docs: DataFrame, model: Model, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score, from the text alone. A name that docs has already gets an underscore before it."""
    runtime.prepare(docs.sparkSession)
    found, name, score = runtime.fresh(docs, "found", name, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("l string, s double")
    def run(t: pd.Series) -> pd.DataFrame:
        runtime.settle()
        langs, s = shared.value.predict([x if isinstance(x, str) else None for x in t])
        return pd.DataFrame({"l": langs, "s": s})

    return docs.withColumn(found, run(F.col(text))).withColumns({name: F.col(found)["l"], score: F.col(found)["s"]}).drop(found)
