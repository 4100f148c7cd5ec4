import random

import numpy as np

from tessera.llm import lines


def brute(texts, min_block=100):
    """(document, line) in a run of lines of min_block characters that an earlier one has."""
    out = set()
    for k, t in enumerate(texts):
        a = t.split("\n")
        for s in range(len(a)):
            for e in range(s + 1, len(a) + 1):
                run = a[s:e]
                if sum(map(len, run)) >= min_block and any(run == b[i : i + e - s] for b in (x.split("\n") for x in texts[:k]) for i in range(len(b))):
                    out |= {(k, i) for i in range(s, e)}
    return out


def test_windows_lie_in_every_shared_block():
    r = random.Random(4)
    for _ in range(300):
        block = [(r.getrandbits(60), r.randint(0, 60)) for _ in range(r.randint(1, 7))]
        if sum(n for _, n in block) < 100:
            continue
        a, b = ([*((r.getrandbits(60), r.randint(0, 60)) for _ in range(r.randint(0, 4))), *block, *((r.getrandbits(60), r.randint(0, 60)) for _ in range(3))] for _ in range(2))
        one, two = (lines.block_windows(np.array([x for x, _ in t]), np.array([n for _, n in t]), 100) for t in (a, b))
        assert set(one) & set(two)


def test_blocks_of_frequent_and_short_lines_go(spark):
    frequent = [f"a frequent line {i} that very many texts have, each by itself" for i in range(3)]
    short = [f"short {i}" for i in range(18)]
    texts = [f"{frequent[i % 3]}\nan own line of text {i} that no other text of all has in it" for i in range(36)]
    texts += ["\n".join([f"own words {i} before", *frequent, f"own words {i} behind"]) for i in range(2)]
    texts += ["\n".join([f"other words {i} before", *short, f"other words {i} behind"]) for i in range(2)]
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["id"], i) for r in lines.mark_common_lines(df).collect() for i in r["gone"] or []}
    assert got == want and {k for k, _ in want} == {37, 39}


def test_pairs_that_no_single_line_makes(spark):
    """Blocks whose lines have other first holders, one by one."""
    one, two = "first half of the block, sixty characters long or just so...", "second half of the block, sixty characters long or just so.."
    tables = [[f"own {0}", f"{one}\nown 1", f"{two}\nown 2", f"{one}\n{two}\nown 3", f"own 4 in front\n{one}\n{two}"]]
    four = [f"line {k} of four in a block that twelve texts share, no more of them" for k in range(4)]
    tables.append([*(f"{x}\nown words of an early text {x[5]}" for x in four), *("\n".join([f"own {i}", *four, f"tail {i}"]) for i in range(12))])
    for texts in tables:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {(r["id"], i) for r in lines.mark_common_lines(df).collect() for i in r["gone"] or []}
        assert got == brute(texts) != set()


def test_random_tables_against_brute_force(spark):
    r = random.Random(11)
    pool = [f"{'x' * r.choice([0, 3, 14, 30, 47, 70, 110])}{k}" for k in range(14)]
    texts = ["\n".join(r.choice(pool) for _ in range(r.choice([0, 3, 8, 14, 30]))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["id"], i) for r in lines.mark_common_lines(df).collect() for i in r["gone"] or []}
    assert got == brute(texts)


def test_moved_and_repeated_blocks_are_aligned():
    r = random.Random(5)
    for _ in range(400):
        size = {r.getrandbits(62): r.choice([0, 20, 55, 90]) for _ in range(8)}
        a, b = ([r.choice(list(size)) for _ in range(r.randint(0, 16))] for _ in range(2))
        got = lines.common_blocks(a, [size[x] for x in a], b, 100)
        want = {i for s in range(len(a)) for e in range(s + 1, len(a) + 1) if sum(size[x] for x in a[s:e]) >= 100
                and any(a[s:e] == b[k : k + e - s] for k in range(len(b))) for i in range(s, e)}
        assert set(got) == want


def test_very_long_text_and_clashing_columns(spark):
    block = [f"line {i} of a very long text that has more than two megabytes in it" for i in range(40_000)]
    df = spark.createDataFrame([(1, "\n".join(block), 7, 8), (2, "\n".join([*block[30_000:], "tail", *block[:10_000]]), 7, 8), (3, None, 7, 8)], "doc_id long, text string, n_removed int, n_lines int")
    got = {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in lines.drop_common_lines(df).collect()}
    assert got[2] == ("tail", 20_001, 20_000) and got[1][2] == 0 and got[3] == (None, 1, 0)
