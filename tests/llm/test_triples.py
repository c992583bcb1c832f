import random

from sketchloom.llm import triples


def test_names_follow_the_order_of_triples(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé") for _ in range(n)) for n in (0, 1, 2, 3, 50, 200)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    for span in (1, 2):
        got = triples.named(triples.sampled_triples(df, span=span)).collect()
        raws = [(t or "").encode() for t in texts]
        want = {(d, i): r[i : i + 3 * span] for d, r in enumerate(raws) for i in range(len(r)) if i % 3}
        order = {k: n for n, k in enumerate(sorted(set(want.values())))}
        assert {(r["u"], r["pos"]): r["name"] for r in got} == {at: order[k] for at, k in want.items()}
