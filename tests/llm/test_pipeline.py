"""The pipeline against a plain version of its stages on a small fixture."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from sievemill.llm import decontaminate, simhash, toxicity
from sievemill.llm.common import space_words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [a + b for a in "bcdfghklmn" for b in ("a", "e", "i", "o", "u", "an", "er")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(25)
    rows, labels = [], []
    for i in range(300):
        text = f"Site menu here\n{prose(40)}\n{prose(30)}" if i % 3 == 0 else f"{prose(40)}\n{prose(30)}"
        kind = "plain"
        if i % 10 == 1:
            text, kind = text + " utter scumbag", "toxic"
        elif i % 10 == 2 and i > 20 and i % 30 != 2:
            text, kind = rows[i - 10][1], "copy"
        elif i % 25 == 3:
            text, kind = f"{prose(5)} {item} {prose(5)}", "leak"
        rows.append((i, text, "en", ["a", "b", None][i % 3], len(text), kind))
        labels.append((i, 0, int(kind == "toxic")))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_stages(spark, folder):
    path, rows, item = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "mixing"]
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "mixing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    kinds = {r[0]: r[5] for r in rows}
    assert set(kept["toxicity"]) == {i for i, k in kinds.items() if k != "toxic"}
    pages, on = Counter(rows[i][3] for i in kept["toxicity"]), Counter((rows[i][3], x) for i in kept["toxicity"] for x in set(rows[i][1].split("\n")))
    gone = {k for k, n in on.items() if n >= 5 and n > 0.02 * pages[k[0]]}
    assert "Site menu here" in {x for _, x in gone}
    assert all(r.text == "\n".join(x for x in rows[i][1].split("\n") if (rows[i][3], x) not in gone) and r.n_chars == len(r.text) for i, r in kept["line_dedup"].items())
    fps = {i: simhash.fingerprint(r.text.encode()) for i, r in kept["line_dedup"].items()}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert set(kept["simhash"]) == {i for i in ids if find(i) == i}
    bench = decontaminate.Benchmark([("1", item.encode())])
    clean = {i for i, r in kept["simhash"].items() if not decontaminate.search_shard([r.text.encode()], bench)[0][1]}
    assert set(kept["decontamination"]) == clean and not any(kinds[i] == "leak" for i in clean)
    sizes = {}
    for i in clean:
        r = kept["decontamination"][i]
        sizes[r.source] = sizes.get(r.source, 0) + len(space_words(r.text.encode()))
    mixed = {}
    for r in docs.collect():
        mixed[r.source] = mixed.get(r.source, 0) + r.words
    total = sum(sizes.values())
    assert abs(mixed["a"] - total / 6) <= 1 and abs(mixed["b"] - total / 3) <= 1 and abs(mixed[None] - total / 2) <= 1
    assert len(toxicity.PREFIXES) == 4


def test_run_and_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    assert {"doc_id", "text", "position", "words"} <= set(corpus_pipeline.run(spark, path).columns)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_of_each_large_copy_group_stays_whole(spark):
    bodies = [f"first line of group {g} {'alpha beta gamma delta'.split()[g]}\n" + " ".join(f"w{g * 977 + j * j}" for j in range(60)) for g in range(4)]
    rows = [(g * 20 + i, b, "en", "a", len(b)) for g, b in enumerate(bodies) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, corpus_pipeline.drop_boilerplate_lines(spark, docs, ""), "")
    assert {r.doc_id: r.text for r in kept.collect()} == {g * 20: b for g, b in enumerate(bodies)}


def test_stages_carry_columns_of_any_name(spark, folder):
    path, rows, _ = folder
    names = ["__rank", "__host", "weight", "start", "hit_items", "tox_score", "line_total", "__x0"]
    docs = spark.createDataFrame([(r[0], r[1], r[3], *[f"{n}{r[0]}" for n in names]) for r in rows[:60]] + [(None, None, None, *names)], ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` string" for n in names]]))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert name == "mixing" or out.columns == docs.columns
        got = out.collect()
        assert all(r[n] in (n, f"{n}{r.doc_id}") for r in got for n in names if n != "line_total")
        docs = spark.createDataFrame(got, out.schema)
    assert {"position", "words", "__x0"} <= set(out.columns) and got
