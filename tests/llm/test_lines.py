import random
import re

import numpy as np
import pytest

from sketchloom.llm import lines

TREE = lines.TemplateTree()


def brute(rows, keep_first=False):
    """The rules over strings: leaves, constant tokens, templates, documents that follow them."""
    leaves, parsed = {}, []
    for u, (_, t) in enumerate(rows):
        mine = []
        for line in t.split("\n") if t is not None else []:
            tokens = re.findall(r"[^\x20\x09-\x0D]+", line)
            masked = ["#" if re.search("[0-9]", x) else x for x in tokens]
            mine.append((tokens, masked, (len(tokens), *masked[:2])))
            for i in range(2, len(tokens)):
                leaves.setdefault((mine[-1][2], i, tokens[i]), set()).add(u)
        parsed.append(mine)

    def templates(tokens, masked, leaf):
        n = len(tokens)
        if not n:
            return
        yield (n, *(masked if 2 * sum(m != "#" for m in masked) >= n else tokens))
        fields = [i for i in range(2, n) if masked[i] != "#" and len(leaves[leaf, i, tokens[i]]) < 5]
        if n >= 4 and fields and not any(i + 1 in fields for i in fields):
            out = ["#" if i in fields else m for i, m in enumerate(masked)]
            if 5 * sum(x != "#" for x in out) >= 3 * n:
                yield (n, *out)

    follow = {}
    for u, mine in enumerate(parsed):
        for line in mine:
            for s in templates(*line):
                follow.setdefault(s, set()).add(u)
    first = {}
    for s, us in follow.items():
        if len(us) >= (2 if s[0] >= 50 and "#" not in s else 5):
            known = [rows[u][0] for u in us if rows[u][0] is not None]
            first[s] = min(known) if known else None
    out = []
    for (i, t), mine in zip(rows, parsed, strict=True):
        if t is None:
            out.append((i, None, 0, 0))
            continue
        gone = [any(s in first and not (keep_first and first[s] == i) for s in templates(*line)) for line in mine]
        out.append((i, "\n".join(x for x, g in zip(t.split("\n"), gone, strict=True) if not g), len(gone), sum(gone)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        t = [" ".join(word() for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            t.insert(rng.randint(0, len(t)), f"Posted on 2024-0{i % 9}-11 by the site team of {word()}")
        if i % 4 == 0:
            t.append("All rights reserved.")
        if i % 5 == 0:
            t.append(f"This page was last\tchanged by {rng.choice(['Ann', 'Bob', 'Cid', 'Dan'])}{rng.randint(0, 1) * 'x'} on {word()}")
        if i % 7 == 0:
            t.append(f"{i} {i + 1} {i + 2} {i + 3}")
        if i in (3, 40):
            t.insert(1, passage)
        if i % 6 == 0:
            t = ["Menu", *t, ""]
        rows.append((i, "\n".join(t)))
    return rows + [(70, None), (71, ""), (72, "\n\n"), (73, "a " * 40_000), (None, "All rights reserved.\r\nlast line here"), (0, rows[0][1]), (74, "é" * 900 + " b c d\n" + "q" * 300)]


def result(out, text="text"):
    return sorted(((r["doc_id"], r[text], r["n_lines_"], r["n_dropped"]) for r in out.collect()), key=repr)


@pytest.mark.parametrize("most", [10**6, 0])  # by broadcast, and by join
@pytest.mark.parametrize("keep_first", [False, True])
def test_matches_brute_force(spark, keep_first, most):
    rows = corpus()
    df = spark.createDataFrame([(t, i, 9) for i, t in rows], "text string, doc_id long, n_lines int").repartition(5)
    out = lines.drop_recurring_lines(df, keep_first=keep_first, broadcast_rows=most)
    assert out.columns == ["text", "doc_id", "n_lines", "n_lines_", "n_dropped"]
    got, want = result(out), brute(rows, keep_first)
    assert got == want and sum(g[3] for g in got) > 40
    assert lines.drop_recurring_lines(df.where("false"), broadcast_rows=most).count() == 0


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lines, "_PIECE", 300)
    rng = random.Random(2)
    body = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    rows = [(i, "\n".join(rng.sample(body, 120)) + "\n" * (i % 3)) for i in range(8)]
    for raw in (t.encode() for _, t in rows):
        raw = np.frombuffer(raw, np.uint8)
        whole, pieces = lines.Lines(raw, np.array([0, len(raw)])), list(lines._pieces(raw, np.array([0, len(raw)])))
        assert len(pieces) > 3
        assert np.concatenate([p.start + a for p, a in pieces]).tolist() == whole.start.tolist()
        assert np.concatenate([p.stop + a for p, a in pieces]).tolist() == whole.stop.tolist()
        assert np.array_equal(np.concatenate([p.leaves(TREE) for p, _ in pieces]), whole.leaves(TREE))
    want = brute(rows)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"id": [i for i, _ in rows], "t": [t for _, t in rows]})
    sent = lambda keys: lines.Keys("", type("Sent", (), {"value": np.array(sorted(keys), np.uint64)}))

    def frequent(keys_of):
        counts = {}
        for b in lines._documents([batch], keys_of):
            for p, n in zip(b["p"].to_numpy().view(np.uint64).tolist(), b["n"].to_pylist(), strict=True):
                counts[p] = counts.get(p, 0) + n
        return sent(p for p, n in counts.items() if n >= 5)

    busy = frequent(lambda piece, _: (piece.leaves(TREE), piece.doc))
    constant = frequent(lambda piece, _: (lambda which, key: (key, piece.doc[piece.line[which]]))(*piece.leaf_tokens(TREE, busy.sent.value)))
    told = [r for b in lines._templates([batch], TREE, busy, constant, "id") for r in b.to_pylist()]
    docs = {}
    for r in told:
        docs.setdefault(r["h"], set()).add(r["id"])
    keys = np.array(sorted(np.uint64(h % 2**64) for h, ids in docs.items() if len(ids) >= 5), np.uint64)
    got = []
    for part, raw, off in lines.text_slices(batch, "t", 300):
        t, n, gone = lines._dropped(part, raw, off, TREE, busy, constant, keys, __import__("pyarrow").array([0] * len(keys)), False)
        got += zip(part["id"].to_pylist(), t.to_pylist(), n.tolist(), gone.tolist(), strict=True)
    assert sorted(got, key=repr) == want


def dropped(spark, texts, ids=None):
    df = spark.createDataFrame(list(zip(ids or [f"d{i}" for i in range(len(texts))], texts, strict=True)), "doc_id string, text string")
    return {r["doc_id"]: r["n_dropped"] for r in lines.drop_recurring_lines(df, keep_first=True).collect()}


def test_fields_of_one_word_are_generalised(spark):
    names = ["ann", "bob", "cid", "dan", "eve", "fay"]
    assert list(dropped(spark, [f"posted by {x} in news" for x in names]).values()).count(1) == 5
    places = ["travel", "sports", "arts", "food", "home", "work"]
    assert list(dropped(spark, [f"posted by {x} in {y}" for x, y in zip(names, places, strict=True)]).values()).count(1) == 5


def test_prose_that_begins_alike_stays(spark):
    ends = ["cold dark monday", "warm tuesday noon", "grey late evening", "bright early morning", "long friday night", "short sunday walk"]
    assert set(dropped(spark, [f"the committee met again on a {x}" for x in ends]).values()) == {0}
    assert set(dropped(spark, [f"{x} the committee met again on a street" for x in ends]).values()) == {0}


def test_short_lines_and_long_passages(spark):
    assert list(dropped(spark, ["Menu"] * 5).values()).count(1) == 4
    assert list(dropped(spark, ["Menu"] * 4).values()).count(1) == 0
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    assert sorted(dropped(spark, [passage, passage]).values()) == [0, 1]
    assert dropped(spark, [passage, passage], [None, "a"]) == {None: 1, "a": 0}
