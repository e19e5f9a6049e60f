from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.splitting import BALANCE, PENALTY, blocks, boundaries, cuts, meeting_points, needed_cuts, split_oversized

TEXTS = st.lists(st.sampled_from(["A word here. ", "Longer sentence with several words, and a clause; ", "Hi\n\n", "\n\n", " ", "x" * 70, "句子在这里。", " ", "End!\n"]), min_size=1, max_size=40).map("".join)


def by_definition(text, limit):
    found = blocks(text, limit)
    return [b[0] for a, b in zip(found, found[1:]) if b[1] - a[0] > limit]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(20, 120), st.integers(0, 60))
def test_pieces_cover_the_text(text, limit, overlap):
    overlap = min(overlap, limit // 2)
    made = cuts(text, limit, overlap)
    starts, ends = [0, *(max(0, c[0] - overlap) for c in made)], [*(c[0] for c in made), len(text)]
    assert all(0 < b - a <= limit or not text for a, b in zip(starts, ends))
    assert all(b - a == min(overlap, b) for a, b in zip(starts[1:], ends)) and ends == sorted(set(ends))
    assert "".join(text[a:b] for a, b in zip([0, *ends], ends)) == text
    if len(text) > limit:
        assert {k for k, _, n in made if n} == {k for k in by_definition(text, limit) if k}


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(20, 120))
def test_meeting_points_by_definition(text, limit):
    found = blocks(text, limit)
    assert meeting_points(found, limit).tolist() == by_definition(text, limit)
    assert all(text[a:b].strip() == text[a:b] for a, b, _ in found)


def cost(text, limit, overlap, path, spots, must):
    edges = [0, *path, len(text)]
    total = sum(PENALTY[spots.get(k, 1)] for k in path)
    for a, b in zip(edges, edges[1:]):
        size = b - max(0, a - overlap)
        if size > limit or any(a < m < b for m in must):
            return float("inf")
        total += BALANCE * (1 - size / limit) ** 2
    return total


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["Some words. ", "And a clause, then more. ", "Hi\n\n", "One two three four.\n\n", "y" * 30]), min_size=2, max_size=6).map("".join), st.integers(24, 60), st.integers(0, 12))
def test_no_other_cuts_cost_less(text, limit, overlap):
    if len(text) <= limit:
        return
    found = blocks(text, limit)
    must = {k for k in by_definition(text, limit) if k}
    spots = {k: v for k, v in boundaries(text, found, limit - overlap).items() if k >= overlap or k in must}
    nodes = sorted(set(spots) | must)
    if len(nodes) > 13:
        return
    least = min(cost(text, limit, overlap, p, spots, must) for n in range(len(nodes) + 1) for p in combinations(nodes, n))
    assert abs(cost(text, limit, overlap, [c[0] for c in cuts(text, limit, overlap)], spots, must) - least) < 1e-9


def test_first_block_shorter_than_the_overlap(spark):
    text = "Hi\n\n" + "p" * 98 + "\n\nand a tail that is long enough."
    items = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, strategy string")
    limits = spark.createDataFrame([("a", 100, 40)], "strategy string, max_chars int, overlap_chars int")
    out = sorted(split_oversized(items, limits, ["doc_id"], start=None).collect(), key=lambda r: r.piece_no)
    assert all(0 <= r.start < r.end and r.text == text[r.start : r.end] and len(r.text) <= 100 for r in out)
    assert (out[0].start, out[0].end, out[1].start, out[-1].end) == (0, 4, 0, len(text))
    assert all(b.start == max(0, a.end - 40) for a, b in zip(out, out[1:]))


def test_cuts_prefer_paragraphs():
    text = "one two three four five\n\nsix seven eight nine ten\n\neleven twelve thirteen"
    assert [text[c[0] :].split()[0] for c in cuts(text, 55, 0)] in (["six"], ["eleven"])


LIMITS = [("a", 40, 5), ("a", 50, 5), ("zero", 0, 0), ("null", None, None), (None, 10, 1)]


def test_frames(spark):
    text = "First paragraph of words here.\n\nSecond paragraph of words.\n\nThird one."
    rows = [(1, 0, text, "a", 10, "x"), (1, 0, text, "a", 10, "x"), (2, 0, text, "other", 0, "x"), (3, 0, text, None, None, "x"), (4, 0, None, "a", 0, "x"), (5, 0, "", "a", 0, "x"), (6, 0, text, "zero", 0, "x"), (7, 0, text, "null", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, chunk_id int, text string, strategy string, start_pos int, max_chars string")
    limits = spark.createDataFrame(LIMITS, "strategy string, max_chars int, overlap_chars int")
    out = split_oversized(df, limits, ["doc_id", "chunk_id"]).collect()
    whole = {r.doc_id: r.text for r in out if r.doc_id not in (1,)}
    assert whole == {2: text, 3: text, 5: "", 6: text, 7: text}
    first = sorted((r for r in out if r.doc_id == 1), key=lambda r: r.piece_no)
    assert all(r.text == text[r.start : r.end] and r.source_start == 10 + r.start and len(r.text) <= 40 for r in first)
    assert sorted(r.cut_at for r in needed_cuts(df, limits, ["doc_id", "chunk_id"]).collect()) == [32]
    assert needed_cuts(df.where("doc_id = 99"), limits, ["doc_id", "chunk_id"]).count() == 0
    assert split_oversized(df, limits.where("max_chars = -1"), ["doc_id", "chunk_id"]).where("doc_id = 1").count() == 2
