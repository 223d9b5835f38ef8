"""What round 4's findings say, on small tables that show it."""

from test_rounds import same_as_sql

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_entities_keep_the_case_found_first(spark, tmp_path):
    texts = ["in Foo. in foo. in FOO. in Zed. at ZED", "to x. to zeD. at Zed. Foo INC. Foo Inc. foo company", "in foo. In FOO. my son Bob. my son BOB. Mr. bob, in Mars. my dad MARS"]
    got = same_as_sql(spark, tmp_path, "entity_regex", documents=([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCUMENTS))
    assert ("Foo", "foo") in {(r["name"], r["key"]) for _, r in got.iterrows()}


def test_only_prefixes_travel_to_blocks(spark, monkeypatch):
    """Whole sets travel where the prefixes leave a pair; rows without id and rows of one id are no pairs."""
    import random

    from mnemoria.operators import similarity

    rng = random.Random(7)
    rows = [(i, [f"m{min(rng.randrange(4000), rng.randrange(4000))}" for _ in range(rng.randrange(1, 120))]) for i in range(400)]
    rows += [(1000 + i, rows[i][1][: -1 - len(rows[i][1]) // 20] + ["x"]) for i in range(30)] + [(None, rows[0][1] + ["y"]), (1001, rows[1][1] + ["y"])]
    df = spark.createDataFrame(rows, "id long, members array<string>")
    sent, real = [], similarity._met
    monkeypatch.setattr(similarity, "_met", lambda cells, *a: sent.append(cells) or real(cells, *a))
    got = {tuple(r) for r in similarity.similar_sets(df, 6, 10, block=64).collect()}
    sets = [(i, frozenset(m)) for i, m in rows if i is not None]
    want = {(min(i, j), max(i, j), len(x & y), len(x | y)) for i, x in sets for j, y in sets if i != j and x != y and len(x & y) * 10 >= len(x | y) * 6}
    assert got == want and len(want) >= 25
    whole = {i: len(m) for i, m in sets}
    assert all(len(r["codes"]) <= 0.4 * whole[r["id"]] + 7 for r in sent[0].collect() if r["id"] not in (1001,))
    assert len({r["id"] for r in sent[1].collect()}) < 150


def test_scores_round_as_sql_does(spark, tmp_path):
    """Halves of the sixth digit, which a double can't hold; large tables of pairs go through products and lists alike."""
    texts = [" ".join(f"w{k}" for k in range(i, i + n)) for i, n in ((0, 640), (599, 41), (0, 5), (100, 9), (3, 130), (0, 323))]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts * 12)]
    got = same_as_sql(spark, tmp_path, "word_jaccard_pairs", documents=(docs, DOCUMENTS))
    assert len(got) == 72 * 71 // 2


def test_pairs_are_counted_by_products_and_by_lists():
    import numpy as np

    from mnemoria.operators import similarity

    rng = np.random.default_rng(3)
    sets = [np.unique(np.minimum(rng.integers(0, 3000, n), rng.integers(0, 3000, n))) for n in rng.integers(0, 200, 300)]
    flat = lambda some: (np.concatenate(some), np.concatenate([[0], np.cumsum([len(t) for t in some])]))
    got = similarity._shared(flat(sets[:120]), flat(sets[120:]))
    assert (got == [[len(np.intersect1d(x, y)) for y in sets[120:]] for x in sets[:120]]).all() and got.max() > 5


def test_words_travel_only_where_a_pair_is_left(spark, monkeypatch):
    """Near copies, equal sets in another order, rows without words; other rows' words stay where they are."""
    import random

    from mnemoria.functions import text as X
    from mnemoria.operators import pack
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(i % 3, i, " ".join(f"w{min(rng.randrange(3000), rng.randrange(3000))}" for _ in range(rng.randrange(5, 90)))) for i in range(300)]
    rows += [(i % 3, 1000 + i, rows[i][2] + " x") for i in range(20)] + [(i % 3, 2000 + i, " ".join(reversed(rows[i][2].split()))) for i in range(20)] + [(None, 3000, None), (None, 3001, None), (1, 3002, ""), (1, 3003, " ")]
    kept, stored = {}, []
    for q, i, t in rows:
        w = None if t is None else frozenset(t.split())
        if not any(w is not None and v is not None and (w == v or (w | v and len(w & v) / len(w | v) > 0.85)) for _, v in kept.setdefault(q, [])):
            kept[q].append((i, w))
    real = pack.store.stored
    monkeypatch.setattr(pack.store, "stored", lambda df, name: stored.append((name, real(df, name))) or stored[-1][1])
    got = pack.near_dup_drop(spark.createDataFrame(rows, "q long, id long, t string"), "q", F.col("id"), F.array_distinct(X.fields(F.col("t"))), ["id"])
    assert {tuple(r) for r in got.collect()} == {(q, p, i) for q, some in kept.items() for p, (i, _) in enumerate(some)}
    sent = [df.count() for name, df in stored if name == "near-dup-sets"]
    assert len(sent) == 1 and 40 <= sent[0] < len(rows) / 3
