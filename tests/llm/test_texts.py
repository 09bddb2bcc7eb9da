import random

import numpy as np
import pytest

from codestrata.llm.boosting import BoostedTrees
from codestrata.llm.holdout import HAND_CHECKED, PARTS, hand_checked
from codestrata.llm.leakage import BAND, BEFORE, GRAM, MOST_CHANGES, STEP, Buckets, banded_runs, common_subsequence, leaked_items, longest_runs
from codestrata.llm.packing import fill_report, pack, place_block, token_sizes
from codestrata.llm.quality import classify, common_set, piece, quality_of, train
from codestrata.llm.text_stats import FEATURES, statistics
from codestrata.llm.weak_labels import FORMS, weak_label
from codestrata.llm.words import reader_words

COMMON = frozenset("the a of to and is it was in that not be as we at on for with der die und nicht ist le la et que de el los no se en".split())


def test_words_as_a_reader_sees_them():
    plain = "should the bloom of tavbrel vanish".split()
    for text in ("Should the **bloom** of Tavbrel vanish?", "> should the\n> bloom of\n> tavbrel vanish", "1  Should the bloom\n2  of Tavbrel vanish", "Ｓhould the b­loom of Tav​brel vanish", "<b>Should</b> the [bloom](x.md) of Tavbrel vani-\nsh", "Shоuld thе bloom оf Tavbrel vanish"):
        assert reader_words(text) == plain, text
    assert reader_words(None) == [] == reader_words("  -- ")


def brute_runs(doc, item, most=3):
    best = [0] * (most + 1)
    for i in range(len(item)):
        for j in range(len(doc)):
            front = {(i, j, 0): 0}
            while front:
                new = {}
                for (a, b, e), n in front.items():
                    steps = []
                    if a < len(item) and b < len(doc) and item[a] == doc[b]:
                        best[e] = max(best[e], n + 1)
                        steps.append((a + 1, b + 1, e, n + 1))
                    if e < most and n:
                        steps += [s for s in ((a + 1, b + 1, e + 1, n + 1), (a + 1, b, e + 1, n + 1), (a, b + 1, e + 1, n)) if s[0] <= len(item) and s[1] <= len(doc)]
                    for a2, b2, e2, n2 in steps:
                        new[(a2, b2, e2)] = max(new.get((a2, b2, e2), 0), n2)
                front = new
    return best


def test_alignment_against_search():
    r = random.Random(5)
    for _ in range(12):
        item, doc = [[r.randrange(4) for _ in range(7)] for _ in range(2)]
        assert longest_runs(np.array([doc]), np.array([item])).tolist() == [brute_runs(doc, item)]


def test_common_subsequence_and_buckets():
    r = random.Random(3)

    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b, 1):
                row.append(max(row[-1], old[j], old[j - 1] + 1 if x == y and x >= 0 else 0))
        return row[-1]

    a, b = ([[r.randrange(-1, 5) for _ in range(n)] for _ in range(40)] for n in (11, 7))
    assert common_subsequence(np.array(a), np.array(b)).tolist() == [brute(x, y) for x, y in zip(a, b)]
    g = np.random.default_rng(1)
    unit = lambda m: (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    vectors = unit(g.normal(size=(60, 32))[g.integers(0, 60, 3000)] + 0.4 * g.normal(size=(3000, 32)))
    queries = unit(vectors[:300] + 0.05 * g.normal(size=(300, 32)))
    found = set(zip(*(x.tolist() for x in Buckets.of(vectors).search(queries, 0.8)[:2])))
    full = set(zip(*(x.tolist() for x in np.nonzero(queries @ vectors.T >= 0.8))))
    assert found <= full and len(found) >= 0.9 * len(full) > 0 and BEFORE % STEP == 0
    assert all(len(x) == 0 for x in Buckets.of(vectors[:1]).search(queries[:0], 0.8))


def test_paraphrases_need_the_words_in_order_and_the_answer(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    query, answer = words[:16], words[40:48]
    changed = [w if i % 4 else "other" for i, w in enumerate(query)]  # 12 of 16 in order, no run
    far = ["between"] * 24
    docs = [(1, " ".join(changed + far + answer)), (2, " ".join(changed)), (3, " ".join(changed[::-1] + far + answer)), (4, " ".join(query)), (5, "")]
    r = random.Random(2)
    docs += [(100 + k, " ".join(r.sample(words, 10))) for k in range(60)]  # all words are about equally common
    items = spark.createDataFrame([("q", " ".join(query), " ".join(answer)), ("r", " ".join(words[20:36]), None)], "id string, query string, answer string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), items, ["query"], answer="answer", least_cosine=0.7).collect()}
    assert got == {(1, "q", "paraphrase"), (4, "q", "run")}


def test_banded_alignment_against_the_whole():
    r = random.Random(12)
    n = 8  # the band holds every alignment of so few words
    for _ in range(30):
        doc, item = [r.randrange(4) for _ in range(n)], [r.randrange(4) for _ in range(n)]
        opposite = [-1] * BAND + item + [-1] * BAND
        assert banded_runs(np.array([doc]), np.array([opposite]), 3).tolist() == longest_runs(np.array([doc]), np.array([item]), 3).tolist()


def leak_tables(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3))
    vocabulary = [word() for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(f"q{i}", text(25), text(60), "x") for i in range(20)] + [("short", "only four words here", None, "x"), ("none", None, "", "x")]
    docs, leaks = [], set()
    for d in range(120):
        body = text(r.choice([0, 10, 200])).split()
        if d % 3 == 0:
            q = items[d % 20]
            words = q[1 + d % 2].split()
            at = r.randrange(len(words) - 12)
            passage = words[at : at + 12]
            if d % 2:
                passage[4] = "changed"
                passage.insert(8, "added")
            where = r.randrange(len(body) + 1)
            body[where:where] = passage
            leaks.add((d, q[0]))
        docs.append((d, "\n> ".join(" ".join(body[k : k + 9]) for k in range(0, len(body), 9)) if d % 5 else " ".join(body), "item"))
    docs += [(500, None, ""), (501, "", ""), (502, items[3][1][: len(items[3][1]) // 3], "")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "id string, query string, answer string, doc_id string"), leaks


@pytest.mark.parametrize("block", [2000, 7])
def test_leaks_are_found_whole_and_only_they(spark, block):
    docs, items, leaks = leak_tables(spark)
    got = leaked_items(docs.union(docs.limit(3)), items, ["query", "answer"], block=block).where("kind = 'run'").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == leaks and len(got) == len(leaks)
    assert leaked_items(docs.limit(0), items, ["query"]).count() == 0 and leaked_items(docs, items.limit(0), ["query"]).count() == 0


def test_least_leaks_among_item_words_are_found(spark):
    r = random.Random(8)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    items = [(f"q{i}", " ".join(r.choice(vocabulary) for _ in range(60))) for i in range(20)]
    docs = []
    for d in range(600):
        # 12 words with 2 changes, from the fifth word of an item's window on, among other words of the items.
        words, body = items[d % 20][1].split(), [r.choice(vocabulary) for _ in range(60)]
        at = 6 * (d % 7) + 4
        passage = words[at : at + 12]
        for k in (3, 8):
            passage[k] = r.choice(vocabulary) if d % 2 else "unknown"
        docs.append((d, " ".join(body[:d % 60] + passage + body[d % 60 :])))
    got = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "id string, query string"), ["query"]).where("kind = 'run'").collect()
    assert {(d, f"q{d % 20}") for d in range(600)} == {(r["doc_id"], r["item_id"]) for r in got}


def test_leaks_contain_one_of_few_changes_and_a_gram():
    # All stretches in place below 12 words with one or two gaps of up to 6 changed or added words each; with three gaps
    # only some lengths (without 7 and 8, gaps up to 4 and 3), and no gap of both kinds. A gap's kind
    # is whether its changes count as words of the item (changed, left out) or not (added).
    for gaps in (1, 2, 3):
        place = np.arange(1, 12) if gaps < 3 else np.array([1, 2, 3, 4, 5, 6, 9, 10, 11])
        gap = np.array([*range(1, 7), *range(-6, 0)]) if gaps < 3 else np.array([1, 2, 3, 4, -1, -2, -3])
        axes = np.meshgrid(*[place] * (gaps + 1), *[gap] * gaps, indexing="ij")
        m, g = np.stack([x.ravel() for x in axes[: gaps + 1]]), np.stack([x.ravel() for x in axes[gaps + 1 :]])
        valid = lambda a, b: ((n := m[a : b + 1].sum(0) + np.maximum(g[a:b], 0).sum(0)) >= 12) & (6 * np.abs(g[a:b]).sum(0) <= n)
        good = np.zeros(m.shape[1], bool)
        for a in range(gaps + 1):
            for b in range(a, gaps + 1):
                good |= valid(a, b) & (np.abs(g[a:b]).sum(0) <= MOST_CHANGES - 1) & (m[a : b + 1].max(0) >= GRAM)
        assert good[valid(0, gaps)].all() and valid(0, gaps).any()


def test_leaks_with_changes_in_one_place_are_found(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    # (where, how many) words of the 24 are replaced or left out: 10, 4, 10 and 6, 1, 4, 3, 10 have no leak of 3 changes in them.
    cases = [[(10, 4)], [(6, 1), (11, 3)]]
    docs = []
    for k, gaps in enumerate(cases):
        for left_out in (False, True):
            passage = [w for i, w in enumerate(words[4:28]) if not left_out or not any(a <= i < a + n for a, n in gaps)]
            if not left_out:
                passage = ["other" if any(a <= i < a + n for a, n in gaps) else w for i, w in enumerate(passage)]
            docs.append((2 * k + left_out, " ".join(["before"] * 9 + passage + ["after"] * 9)))
    docs.append((9, " ".join(["before"] * 9 + words[4:14] + ["other"] * 5 + words[19:29])))
    docs += [(None, docs[0][1]), (2**62 + 1, docs[0][1])]
    got = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("q", " ".join(words))], "id string, query string"), ["query"]).where("kind = 'run'").collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2, 3, 2**62 + 1}


def test_hand_checked_forms_and_boosting():
    x = np.array([statistics(t, COMMON) for t, _ in HAND_CHECKED])
    assert x.shape[1] == len(FEATURES) and np.isfinite(x).all()
    parts = [hand_checked(p) for p in PARTS]
    assert sum(len(t) for t, _ in parts) == len(HAND_CHECKED) and all(set(y) == {0, 1, 2, 3} for _, y in parts)
    sure = [(weak_label(t, COMMON), f) for t, f in HAND_CHECKED]
    assert np.mean([FORMS[k[0]] == f for k, f in sure if k]) >= 0.9 and any(k is None for k, _ in sure)
    r = np.random.default_rng(0)
    a = r.normal(size=(600, 5))
    b = (a[:, 0] > 0).astype(int) + 2 * (a[:, 1] * a[:, 2] > 0)
    for columns in (1.0, 0.8):
        model = BoostedTrees(("p", "q", "r", "s"), columns=columns).fit(a[:400], b[:400])
        assert (model.probabilities(a[400:]).argmax(1) == b[400:]).mean() > 0.85
    for text in (None, "", " \n\t"):
        assert statistics(text, COMMON) is None
    assert all(np.isfinite(statistics(t, COMMON)).all() for t in ("x", "\u200b.", "a" * 100_000, "| |\n" * 1000, "\ud800 \U0001f388"))
    assert piece("a\nb\nc") in "a\nb\nc" and piece("") == ""


def test_forms_on_the_cluster(spark, sf_dir):
    docs = spark.createDataFrame([(i, t, "kept") for i, (t, _) in enumerate(HAND_CHECKED)] + [(900, None, ""), (901, " ", ""), (None, "no id", "")], "doc_id bigint, text string, stats string")
    words = spark.createDataFrame([("en", w, 1) for w in sorted(COMMON)] + [("en", None, 2)], "lang string, word string, frequency_rank int")
    got = {r["doc_id"]: r["form"] for r in classify(docs, train(docs, words)).collect()}
    assert set(got) == set(range(len(HAND_CHECKED)))
    assert np.mean([got[i] == f for i, (_, f) in enumerate(HAND_CHECKED)]) >= 0.9
    assert classify(docs.limit(0), train(docs.limit(0), words)).count() == 0
    # Held-out accuracy of what other texts teach.
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/common_words.parquet"))
    measured = quality_of(model, *hand_checked("test"))
    assert measured["accuracy"] >= 0.75 and measured["log_loss"] < 0.8
    with pytest.raises(ValueError):
        common_set(spark.range(10_001).selectExpr("concat('w', id) AS word"))


def test_containers(spark):
    r = random.Random(7)
    sizes = [(i, r.choice([1, 5, 30, 90, 100, 250]), 0) for i in range(500)] + [(7, 30, 30), (7, 30, 30), (900, 0, 0), (901, 1003, 500)]
    df = spark.createDataFrame(sizes, "item_id bigint, tokens int, loss_tokens int")
    placed = pack(df, [100, 400, 100], tokens_per_segment=10).toPandas()
    for capacity, g in placed.groupby("capacity"):
        boxes = g.groupby(["block", "container"])
        assert boxes.tokens.sum().max() <= capacity and boxes.size().max() <= capacity // 10 and boxes.loss_tokens.sum().max() <= capacity
        assert g.tokens.sum() == sum(t for _, t, _ in sizes)
        pieces = g[g.item_id == 901].sort_values("piece")
        assert pieces.tokens.tolist() == [capacity] * (1003 // capacity) + [1003 % capacity]
        assert (g[g.tokens == capacity].item_id.isin([i for i, t, _ in sizes if t >= capacity])).all()
        assert len(boxes) <= 1.1 * g.tokens.sum() / capacity + 2
    assert fill_report(pack(df, [400])).first()["fill"] > 0.9
    assert pack(df.limit(0), [100]).count() == 0
    out = place_block(np.array([[5, 1, 0]] * 7), np.array([10, 3, 10]))
    assert np.bincount(out).tolist() == [2, 2, 2, 1]


@pytest.mark.parametrize("item, per_segment, share, most", [((10, 5), 1, 1.0, 10), ((10, 5), 25, 1.0, 4), ((10, 5), 1, 0.3, 6)])
def test_each_limit_of_containers_acts(spark, item, per_segment, share, most):
    # 10 tokens, 5 of them with loss: by tokens 10 fit into 100, by segments 100 // 25, by loss 30 // 5.
    placed = pack(spark.createDataFrame([(i, *item) for i in range(60)], "item_id bigint, tokens int, loss_tokens int"), [100], tokens_per_segment=per_segment, loss_share=share)
    row = fill_report(placed).first()
    assert (row["containers"], row["most_segments"], row["fullest"], row["most_loss"]) == (60 // most, most, 10 * most, 5 * most)


def test_pieces_above_the_loss_limit_stay_whole_and_alone_with_loss(spark):
    rows = [(i, 90, 90) for i in range(5)] + [(10 + i, 10, 0) for i in range(5)] + [(20, 150, 150), (21, 2_000_000, 1_900_000)]
    placed = pack(spark.createDataFrame(rows, "item_id bigint, tokens int, loss_tokens int"), [100], tokens_per_segment=10, loss_share=0.8).toPandas()
    whole = placed[placed.item_id < 20].sort_values("item_id")
    assert whole.tokens.tolist() == [90] * 5 + [10] * 5 and whole.loss_tokens.tolist() == [90] * 5 + [0] * 5
    assert placed[placed.item_id == 20].sort_values("piece")[["tokens", "loss_tokens"]].values.tolist() == [[100, 100], [50, 50]]
    assert placed[placed.item_id == 21].loss_tokens.sum() == 1_900_000
    boxes = placed.groupby(["block", "container"]).agg(tokens=("tokens", "sum"), loss=("loss_tokens", "sum"), bearing=("loss_tokens", lambda v: (v > 0).sum()))
    assert boxes.tokens.max() <= 100 and (boxes[boxes.loss > 80].bearing == 1).all()


def test_token_sizes_round_trip(spark):
    from codestrata.llm.packing import _encoder, default_tokenizer

    letters = random.Random(9)
    texts = ["Hello there.", "> quoted line\nanswer", "ünïcode — 漢字 🎈", "x" * 5000, None, "", "prose and " + "".join(letters.choice("abcdefgh") for _ in range(6000)) + " more prose"]
    got = {r["item_id"]: r for r in token_sizes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert set(got) == {0, 1, 2, 3, 6} and got[1]["loss_tokens"] < got[1]["tokens"] and got[0]["loss_tokens"] == got[0]["tokens"]
    encoder = _encoder(default_tokenizer())
    assert all(got[i]["tokens"] == len(encoder.encode_ordinary(texts[i])) for i in got)
    assert all(encoder.decode(encoder.encode_ordinary(t)) == t for t in texts[:3])
