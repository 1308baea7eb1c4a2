import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from portolan.llm import mixing
from portolan.llm.common import table


@pytest.mark.parametrize("seed", range(6))
def test_schedule_stays_within_a_block_of_every_weight(seed):
    rnd = random.Random(seed)
    weights = {f"s{i}": rnd.choice([0.1, 1, 3, 10, 50]) * rnd.random() + 0.01 for i in range(rnd.randrange(1, 30))}
    ratios = mixing.whole_ratios(weights)
    total = sum(ratios.values())
    done = Counter()
    found = mixing.placed_blocks(ratios, {s: 1000 for s in ratios})
    for i, (source, block, slot, first, due) in zip(range(512), found):
        assert slot == i and first <= slot < due
        done[source] += 1
        assert block == done[source]
        assert all(abs(done[s] * total - ratio * (slot + 1)) < total for s, ratio in ratios.items())


def check(rows, out, weights, block):
    """The placed rows hold every row once, in the schedule's places."""
    assert Counter((r.doc_id, r.source) for r in out) == Counter((i, s) for i, _, s in rows)
    sizes = Counter(s for _, _, s in rows)
    ratios = mixing.whole_ratios({s: weights[s] for s in sizes})
    slot_of = {(s, j - 1): places for s, j, *places in mixing.placed_blocks(ratios, {s: -(-n // block) for s, n in sizes.items()})}
    places = defaultdict(set)
    for r in out:
        assert [r.slot, r.release, r.deadline] == slot_of[r.source, r.block]
        assert r.share == float(Fraction(ratios[r.source], sum(ratios.values())))
        places[r.source].add(r.block * block + r.offset)
    assert all(places[s] == set(range(n)) for s, n in sizes.items())
    assert len({(r.slot, r.offset) for r in out}) == len(rows)


def test_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check(rows, mixing.mix_exact(docs).collect(), mixing.source_weights(docs), mixing.BLOCK)


def test_odd_rows(documents):
    rows = [(i, f"text {i}", "hot") for i in range(500)] + [(i, "t", f"s{i % 7}") for i in range(500, 540)]
    rows += [(None, None, None), (None, "", None), (1, "text 1", "hot"), (1, "text 1", "hot"), (600, "x", "")]
    df = documents(rows, extra=("slot", "s", "row", "share", "bucket", "n", "at", "name", "block", "tie"))
    weights = {s: 1.0 for _, _, s in rows} | {"hot": 20.0}
    out = mixing.mix_exact(df, weights, block=3).collect()
    check(rows, out, weights, 3)
    ordered = mixing.mixed_order_exact(df, weights, block=3)
    assert ordered.columns == df.columns
    by_place = [(r.source) for r in sorted(out, key=lambda r: (r.slot, r.offset))]
    assert [r.source for r in ordered.collect()] == by_place
    with pytest.raises(ValueError):
        mixing.mix_exact(df, {"hot": 1.0})


def test_exact_weights_hold_over_many_rounds_with_many_sources():
    given = {"big": 0.9} | {f"s{i}": 0.1 / 199 for i in range(199)}
    ratios = mixing.whole_ratios(given)
    exact = {s: Fraction(w) / sum(map(Fraction, given.values())) for s, w in given.items()}
    assert all(Fraction(ratios[s], sum(ratios.values())) == w for s, w in exact.items())
    slots = 20 * 1024
    done = Counter()
    blocks = {s: int(w * slots) + 2 for s, w in exact.items()}
    for i, (source, block, slot, first, due) in enumerate(mixing.placed_blocks(ratios, blocks)):
        if i == slots:
            break
        assert slot == i and first <= slot < due
        done[source] += 1
        assert block == done[source]
        assert first == math.floor((block - 1) / exact[source]) and due == math.ceil(block / exact[source])
        if i % 97 == 0:
            assert all(abs(done[s] - w * (i + 1)) < 1 for s, w in exact.items())
    assert abs(done["big"] / slots - 0.9) < 1e-4


def test_sources_that_run_out_leave_the_windows_of_the_others():
    found = list(mixing.placed_blocks({"a": 5, None: 3, "": 2}, {"a": 2, None: 40, "": 7}))
    assert Counter(s for s, *_ in found) == {"a": 2, None: 40, "": 7}
    assert all(first <= slot < due for _, _, slot, first, due in found)
    assert len({slot for _, _, slot, _, _ in found}) == 49


def test_query_follows_the_given_weights(documents):
    rows = [(i, f"t{i}", "big") for i in range(900)] + [(1000 + i, "t", f"s{i % 49}") for i in range(98)] + [(None, None, None)] * 2
    weights = {s: 1.0 for _, _, s in rows} | {"big": 450.0}
    df = documents(rows, extra=("slot", "s", "row", "share", "bucket", "n", "name", "block", "tie", "release"))
    out = mixing.mix_exact(df, weights, block=1).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((i, s) for i, _, s in rows)
    assert len({(r.slot, r.offset) for r in out}) == len(rows) and all(r.release <= r.slot < r.deadline for r in out)
    done = Counter()
    for i, r in enumerate(sorted(out, key=lambda r: r.slot)[:490]):
        done[r.source] += 1
        assert r.slot == i and all(abs(done[s] - Fraction(w) / 500 * (i + 1)) < 1 for s, w in weights.items())
    assert mixing.mixed_order_exact(df, weights, block=1).columns == df.columns
    assert mixing.mix_exact(df.limit(0)).count() == 0 and mixing.mixed_order_exact(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_exact(df, {"big": 1.0})
