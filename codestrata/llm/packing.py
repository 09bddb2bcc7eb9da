"""Texts put together into containers of fixed capacity: vector bin packing with the dot-product heuristic."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import spread

#: Lines that carry no loss in instruction data: what was quoted or asked.
PROMPT_LINE = r"(?m)^[ \t]*(?:>|Q:|User:|Human:).*$"
#: Items packed together in one task at most; with thousands of items a block's last, half-filled container weighs little.
BLOCK_ITEMS = 4096
ITEM_SCHEMA = "item_id bigint, piece int, start_token int, tokens int, segments int, loss_tokens int, capacity int"
PLACED_SCHEMA = "capacity int, block bigint, container int, item_id bigint, piece int, start_token int, tokens int, segments int, loss_tokens int"


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Byte-level BPE from a vocabulary file of a public tokenizer (base64 token and rank a line)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> str:
    return os.environ.get("CODESTRATA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def token_sizes(docs: DataFrame, tokenizer: str | None = None, prompt_line: str = PROMPT_LINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, tokens, loss_tokens) of every text: a map over whole texts, without shuffle. Null and empty texts give no row."""
    path = tokenizer or default_tokenizer()
    asked = re.compile(prompt_line)
    docs.sparkSession.sparkContext.addFile(path)  # executors need no such folder of their own

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(SparkFiles.get(os.path.basename(path)))
        size = lambda t: len(encoder.encode_ordinary(t))
        for pdf in batches:
            ids, tokens, loss = [], [], []
            for i, t in zip(pdf["item_id"], pdf["text"]):
                n = size(t)
                ids.append(i)
                tokens.append(n)
                loss.append(n - min(n, sum(size(q) for q in asked.findall(t))))
            yield pd.DataFrame({"item_id": ids, "tokens": tokens, "loss_tokens": loss})

    texts = docs.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    return spread(texts).mapInPandas(run, "item_id bigint, tokens int, loss_tokens int")


def place_block(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of every item; demand (items, 3) fits limits (3,) item by item.

    One container is open at a time. It is begun with the item of the greatest share of a limit and takes, as long as
    any fits, the item whose demand has the greatest dot product with what is left (both as shares of the limits);
    equal ones in the order given. Equal demands are one kind, so a step looks at kinds and not at items.
    """
    kinds, kind_of = np.unique(demand, axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    members = np.argsort(kind_of, kind="stable")
    left = np.bincount(kind_of, minlength=len(kinds))
    taken = np.concatenate([[0], np.cumsum(left)[:-1]])
    share = kinds / limits
    big = share.max(1)
    out = np.full(len(demand), -1, np.int32)
    live = np.arange(len(kinds))
    container = 0
    while len(live):
        rest = limits.astype(np.int64).copy()
        k = live[int(np.argmax(big[live]))]
        while True:
            out[members[taken[k]]] = container
            taken[k] += 1
            left[k] -= 1
            rest = rest - kinds[k]
            if not left[k]:
                live = live[live != k]
            fits = live[(kinds[live] <= rest).all(1)]
            if not len(fits):
                break
            k = fits[int(np.argmax(share[fits] @ (rest / limits)))]
        container += 1
    return out


def pack(sizes: DataFrame, capacities: list[int], tokens_per_segment: int = 32, loss_share: float = 1.0) -> DataFrame:
    """PLACED_SCHEMA: where every item lies, for each capacity.

    An item that alone exceeds a capacity is split into full pieces and a rest, in order; no other is split. A container
    holds at most the capacity in tokens, one piece for each `tokens_per_segment` of the capacity and `loss_share` of the capacity in
    loss-bearing tokens; a piece's loss is its share of the item's. A piece whose own loss is above that limit isn't split
    for it: it is the only one with loss in its container, which pieces without loss may fill. Items are spread over blocks of
    about BLOCK_ITEMS pieces by hash, so a task holds a bounded number however many items or equal items there are;
    repeated rows are items of their own. Items of no tokens are left out. Empty in, empty out.
    """
    sized = sizes.where(F.col("tokens") > 0)
    each = sized.withColumn("capacity", F.explode(F.array(*[F.lit(int(c)) for c in sorted(set(capacities))])))
    pieces = F.ceil(F.col("tokens") / F.col("capacity")).cast("int")
    cut_up = each.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn("start_token", F.col("piece") * F.col("capacity"))
    size = F.least(F.col("capacity"), F.col("tokens") - F.col("start_token"))
    # Loss up to the piece's end less that up to its start: the pieces' losses add up to the item's.
    upto = lambda t: F.round(F.col("loss_tokens").cast("double") * t / F.col("tokens")).cast("int")
    loss = upto(F.col("start_token") + size) - upto(F.col("start_token"))
    items = cut_up.select("item_id", "piece", "start_token", size.cast("int").alias("tokens"), F.lit(1).alias("segments"), loss.alias("loss_tokens"), "capacity")
    counts = items.groupBy("capacity").agg(F.count("*").alias("_n"))  # one row a capacity
    blocked = items.join(F.broadcast(counts), "capacity").withColumn("block", F.pmod(F.xxhash64("item_id", "piece"), F.ceil(F.col("_n") / BLOCK_ITEMS))).drop("_n")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "item_id", "piece"], ascending=[False, True, True], kind="stable")
        capacity = int(pdf["capacity"].iloc[0])
        limits = np.array([capacity, max(1, capacity // tokens_per_segment), max(1, int(capacity * loss_share))])
        demand = pdf[["tokens", "segments", "loss_tokens"]].to_numpy(np.int64)
        demand[:, 2] = np.minimum(demand[:, 2], limits[2])  # above the limit it takes the whole of it
        pdf["container"] = place_block(demand, limits)
        return pdf[[c.split()[0] for c in PLACED_SCHEMA.split(", ")]]

    return blocked.groupBy("capacity", "block").applyInPandas(place, PLACED_SCHEMA)


def fill_report(placed: DataFrame) -> DataFrame:
    """Per capacity: containers, pieces, tokens, share of the space used."""
    boxes = placed.groupBy("capacity", "block", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.sum("loss_tokens").alias("l"))
    return boxes.groupBy("capacity").agg(
        F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.max("n").alias("most_segments"), F.max("l").alias("most_loss"),
        F.round(F.sum("t") / (F.count("*") * F.col("capacity")), 6).alias("fill"),
    )
