"""Arrays cut anywhere have the items that one pass finds."""

import json
import random

import pytest

from orrery.sources import json_items, readers


def value(rng, depth=0):
    texts = ["", "}", "{", "a,b", '"', "\\", '\\"}', "[x]", "é}", "\n", "},{", "tail\\"]
    kind = rng.randint(0, 5 if depth < 3 else 2)
    if kind <= 1:
        return "".join(rng.choice(texts) for _ in range(rng.randint(0, 4)))
    if kind == 2:
        return rng.choice([1, -2.5, True, None])
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice("ab}") + str(k): value(rng, depth + 1) for k in range(rng.randint(0, 3))}


@pytest.mark.parametrize("size", [17, 64, 1_000_000])
def test_items_of_any_split(spark, tmp_path, size):
    want = {}
    for k in range(6):
        rng = random.Random(k)
        found = [value(rng) for _ in range([40, 25, 1, 0, 30, 12][k])]
        text = json.dumps(found, ensure_ascii=k % 2 == 0, indent=[None, 2][k // 2 % 2])
        (tmp_path / f"f{k}.json").write_text([text, f" \n{text}\n"][k % 2])
        want[f"f{k}.json"] = found
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for most in (json_items.MOST_SENT, 0):
            json_items.MOST_SENT, kept = most, json_items.MOST_SENT
            try:
                rows = json_items.items(spark, str(tmp_path)).collect()
                numbered = json_items.objects(spark, str(tmp_path), run=4).collect() if most else []
            finally:
                json_items.MOST_SENT = kept
            got = {}
            for r in sorted(rows, key=lambda r: r.nth):
                got.setdefault(r.file.rpartition("/")[2], []).append(json.loads(r.item))
            assert got == {k: v for k, v in want.items() if v}
            if most:
                assert sorted((r.file.rpartition("/")[2], r.pos, json.dumps(json.loads(r.item))) for r in numbered) == sorted((k, n, json.dumps(x)) for k, v in want.items() for n, x in enumerate(x for x in v if isinstance(x, dict)))
                if size == 17:
                    assert json_items.pieces(spark, str(tmp_path / "f0.json")).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_no_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(' {"a": [1]}')
    with pytest.raises(ValueError, match="no JSON array"):
        readers.json_array(spark, str(tmp_path / "a.json"))
