"""Pfair mixing: every row once, less than a block off target at every slot of a phase."""

import collections

import pytest

from repograin.llm import mixing


def stream(spark, sizes, targets, rest=1.0, **options):
    rows, at = [], 0
    for source, n in sizes.items():
        rows += [(at + i, source, "kept", 1) for i in range(n)]
        at += n
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, mix_slot string, _mix_hash int")
    return rows, mixing.mix(docs, targets, rest, **options).collect()


@pytest.mark.parametrize("cycle", [50, 1000])
def test_less_than_one_block_off(spark, cycle):
    sizes = {"a": 900, "b": 300, "c": 37, "d": 5, None: 20, "e": 11}
    targets = {"a": 5.0, "b": 2.5, "c": 1.7, "d": 0.3, "absent": 2.0}
    rows, got = stream(spark, sizes, targets, 0.9, block_rows=2, cycle=cycle)
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    assert len({r.mix_position for r in got}) == len(got)
    phases = collections.defaultdict(dict)
    for r in got:
        held = phases[r.mix_phase].setdefault(r.mix_slot, (r.mix_source, r.mix_block))
        assert held == (r.mix_source, r.mix_block)  # one block per slot
    slots = sorted(s for p in phases.values() for s in p)
    assert slots == list(range(len(slots)))
    weights = [*targets.values(), 0.9]
    for number, phase in sorted(phases.items()):
        total = collections.Counter(source for source, _ in phase.values())
        length, done = len(phase), collections.Counter()
        for t, slot in enumerate(sorted(phase), 1):
            done[phase[slot][0]] += 1
            for source, n in total.items():
                assert abs(done[source] - n * t / length) < 1
        if number == 0:  # no source has run out: shares are the targets of those present, to the cycle's resolution
            live = sum(w for s, w in enumerate(weights) if total[s])
            for s, n in total.items():
                assert abs(n / length - weights[s] / live) <= 1 / cycle + 1 / length


def test_ties_names_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None)], "doc_id bigint, source string")
    mixed = mixing.mixed(docs, {"a": 1.0}, 1.0, block_rows=1)
    assert mixed.columns == docs.columns and mixed.count() == 4
    assert mixing.mix(docs.limit(0), {"a": 1.0}, 1.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0.0}, 1.0)


def test_settings_do_not_change_the_mix(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source")
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append(sorted(map(tuple, mixing.mix(docs, {"a": 1.0}, 1.0).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
