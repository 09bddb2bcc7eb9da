"""Natural prose told from lists, tables and junk: boosted trees on document statistics.

The trees are trained on a bounded sample of texts, and pieces of them, that hand-written line rules label where they are
sure (weak_labels), and on a third of the hand-checked texts; what they see are statistics that know nothing of those
rules. Each tree may split on a few columns only, so that no single clean one decides. Probabilities are calibrated on
another third of the hand-checked texts; the last third tells how good they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.boosting import BoostedTrees
from codestrata.llm.holdout import hand_checked
from codestrata.llm.text_stats import FEATURES, MOST_COMMON, statistics
from codestrata.llm.weak_labels import FORMS, weak_label
from codestrata.session import spread

#: Texts labelled for training, about, and what a hand-checked one weighs against a clear one of them.
SAMPLE, SEED_WEIGHT = 3000, 8.0


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def common_set(common_words: DataFrame) -> frozenset[str]:
    """The fixed table of common words, its size checked."""
    listed = [r[0] for r in common_words.where(F.col("word").isNotNull()).select(F.lower("word")).distinct().limit(MOST_COMMON + 1).collect()]
    if len(listed) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    return frozenset(listed)


def piece(text: str) -> str:
    """Two to eight successive lines of a text, always the same."""
    lines, draw = text.splitlines(), zlib.crc32(text.encode("utf-8", "surrogatepass"))
    n = 2 + draw % 7
    at = draw // 7 % max(1, len(lines) - n + 1)
    return "\n".join(lines[at : at + n])


@dataclass
class FormModel:
    common: frozenset[str]
    trees: BoostedTrees

    def rows(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """Places of the texts that aren't blank, and what the trees see of them."""
        found = [(i, s) for i, t in enumerate(texts) if (s := statistics(t, self.common)) is not None]
        return [i for i, _ in found], np.array([s for _, s in found]).reshape(len(found), len(FEATURES))


def train(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> FormModel:
    """The model of about `sample` texts, those of least id hash; their number is the only thing bounded here.

    Each partition drops the other texts where it reads them, so nothing is sorted or moved but the sample. Unclear
    texts of the sample aren't trained on.
    """
    common = common_set(common_words)
    texts = _texts(docs, id_col, text_col)
    share = sample / max(texts.count(), 1)
    chosen = texts if share >= 1 else texts.where(F.xxhash64("doc_id") < F.lit(int((share * 2 - 1) * 2**63)))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, *found, s) for i, t in zip(pdf["doc_id"], pdf["text"]) for k, x in enumerate((t, piece(t))) if (s := statistics(x, common)) is not None and (found := weak_label(x, common))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "label", "weight", "stats"])

    rows = spread(chosen).mapInPandas(label, "doc_id bigint, piece int, label int, weight double, stats array<double>").collect()
    rows = sorted(((r["doc_id"], r["piece"], r["label"], r["weight"], r["stats"]) for r in rows), key=lambda r: r[:2])
    seed, seed_y = hand_checked("seed")
    x = np.array([*(r[4] for r in rows), *(statistics(t, common) for t in seed)])
    y = np.array([*(r[2] for r in rows), *seed_y])
    weights = np.array([*(r[3] for r in rows), *[SEED_WEIGHT] * len(seed)])
    model = FormModel(common, BoostedTrees(FORMS, rounds=100, rate=0.15, columns=0.1).fit(x, y, weights))
    held, held_y = hand_checked("calibration")
    model.trees.calibrate(model.rows(held)[1], np.array(held_y))
    return model


def classify(docs: DataFrame, model: FormModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, form, p_prose, p_list, p_table, p_junk) of every document with text: one map over whole texts, no shuffle.

    Documents without an id, null and blank texts give no row; repeated rows give theirs again; other columns are left out.
    """
    bound = docs.sparkSession.sparkContext.broadcast(model)  # common words and trees: of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = bound.value
        for pdf in batches:
            at, x = m.rows(pdf["text"].tolist())
            if at:
                p = m.trees.probabilities(x)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[at], "form": [FORMS[k] for k in p.argmax(1)], **{f"p_{f}": p[:, k] for k, f in enumerate(FORMS)}})

    return spread(_texts(docs, id_col, text_col)).mapInPandas(run, "doc_id bigint, form string, p_prose double, p_list double, p_table double, p_junk double")


def quality_of(model: FormModel, texts: list[str], forms: list[int], bins: int = 5) -> dict[str, float]:
    """Accuracy, log loss and expected calibration error on labelled texts."""
    p = model.trees.probabilities(model.rows(texts)[1])
    y = np.array(forms)
    sure, right = p.max(1), p.argmax(1) == y
    place = np.minimum((sure * bins).astype(int), bins - 1)
    error = sum(abs(sure[place == b].mean() - right[place == b].mean()) * (place == b).mean() for b in range(bins) if (place == b).any())
    return {"accuracy": float(right.mean()), "log_loss": float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-9)).mean()), "calibration_error": float(error)}
