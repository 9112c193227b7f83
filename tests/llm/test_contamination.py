import random

import numpy as np

from quaystone.llm.contamination import ItemIndex, has_stretch, item_indexes, leaked_items, least_kept, normal_words


def _brute(item, doc):
    for a in range(len(item)):
        for b in range(a + 20, len(item) + 1):
            # The first and the last item word of the stretch stand in the text.
            before = [0 if y == item[a] else 99 for y in doc]
            for x in item[a + 1 : b - 1]:
                now = [99] * len(doc)
                for j, y in enumerate(doc):
                    now[j] = min(before[j] + 1, (before[j - 1] + (x != y)) if j else 99, (now[j - 1] + 1) if j else 99)
                before = now
            ends = [before[j - 1] for j, y in enumerate(doc) if j and y == item[b - 1]]
            if ends and min(ends) <= (b - a) // 8:
                return True
    return False


def test_alignment_against_brute_force():
    rng = np.random.default_rng(9)
    seen = set()
    for _ in range(60):
        m = int(rng.integers(20, 29))
        item = rng.integers(1, 40, m)
        doc = item[: int(rng.integers(17, m + 1))].tolist()
        for _ in range(int(rng.integers(0, 5))):
            k, op = int(rng.integers(0, len(doc))), rng.integers(0, 3)
            if op == 0:
                doc[k] = int(rng.integers(1, 60))
            elif op == 1:
                doc.pop(k)
            else:
                doc.insert(k, int(rng.integers(1, 60)))
        doc = np.array([*rng.integers(1, 40, 4), *doc, *rng.integers(1, 40, 4)])
        want = _brute(item, doc)
        seen.add(want)
        assert has_stretch(item, doc) == want
    assert seen == {True, False}


def test_index_finds_what_brute_force_finds():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(6)]
    index = ItemIndex.of_texts(items)
    for _ in range(150):
        k = rng.randrange(6)
        words = items[k][1].split()
        start, length = rng.randrange(0, 30), rng.randrange(14, 31)
        part = words[start : start + length]
        for _ in range(rng.randrange(0, 5)):
            part[rng.randrange(len(part))] = "zz" + str(rng.randrange(99))
        text = ["x"] * rng.randrange(0, 30) + part + ["y"] * 10
        ids = {w: i + 1 for i, w in enumerate(sorted({*words, *text}))}
        want = _brute([ids[w] for w in words], [ids[w] for w in text])
        assert (k in index.leaks(" ".join(text))) == want


def test_normalisation():
    plain = normal_words("Le conseil de Brück garda 12 pièces, d'accord")
    for variant in ("LE CONSEIL DE BRUCK GARDA 12 PIECES D ACCORD", "Le&nbsp;con­seil <b>de</b> Br&uuml;ck ​garda 12 pi\\u00e8ces, d’accord", "Le conseil\n> de  Brück\tgarda 12 piÃ¨ces; d'accord", "Le con-\nseil de Brück garda 12 pi%C3%A8ces, d'accord"):
        assert normal_words(variant) == plain
    assert normal_words(None) == [] and normal_words("") == []


def test_least_kept_against_brute_force():
    import itertools

    for run in (4, 6):
        for words in (20, 21, 23):
            # Every place of the two edits in a stretch of 20 words: unbroken runs that stay.
            fewest = min(sum(all(k not in (a, b) for k in range(at, at + run)) for at in range(20 - run + 1)) for a, b in itertools.combinations(range(1, 19), 2))
            assert 1 <= least_kept(words, run) <= fewest
    assert least_kept(19, 4) == 0 and least_kept(20, 6) == 3 and least_kept(24, 6) == 1


def test_a_long_tag_is_no_difference():
    words = [f"word{i}" for i in range(24)]
    index = ItemIndex.of_texts([(1, " ".join(words))])
    for size in (10, 500, 5000):
        tag = f'<span data-note="{"q" * size}">'
        assert index.leaks(" ".join(words[:12]) + " " + tag + " ".join(words[12:])) == [1]
    assert normal_words("a < b and c > d") == ["a", "b", "and", "c", "d"]


def test_texts_of_a_batch_stay_apart():
    words = [f"w{i}" for i in range(30)]
    index = ItemIndex.of_texts([(7, " ".join(words))])
    assert index.search([words[:15], words[15:], words, [], words[3:24]]) == [(2, 7), (4, 7)]
    # A template shared by many items, sizes in different partitions.
    many = ItemIndex.of_texts([(k, " ".join(words[:20] + [f"own{k}_{j}" for j in range(k)])) for k in range(0, 200, 10)])
    assert len(many.partitions) > 2 and len(many.leaks(" ".join(words[:20]))) == 20
    assert len(many.leaks(" ".join(words[1:20]))) == 0


def test_index_size_is_bounded():
    items = [(k, " ".join(f"v{k}x{j}" for j in range(50))) for k in range(40)]
    one, parts = item_indexes(items), item_indexes(items, 50_000)
    assert len(one) == 1 and len(parts) > 3 and all(p.nbytes <= 50_000 for p in parts)
    assert sorted(i for p in parts for i in p.ids) == list(range(40))


def test_operator_cases(spark):
    item = " ".join(f"word{i}" for i in range(40))
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "too short", "x"), (1, item, "x")], "item_id long, item_text string, text string")
    docs = [(10, f"before {item} after", 0), (10, f"before {item} after", 0), (11, " ".join(item.split()[:18]), 0), (12, None, 0), (13, "", 0), (14, "filler " * 40000 + " ".join(item.split()[5:27]), 0), (None, item, 0)]
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), items).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == [("10", 1), ("14", 1), ("None", 1)]
    in_blocks = leaked_items(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), items, index_bytes=1, blocks_a_pass=1).collect()
    assert sorted(map(str, in_blocks)) == sorted(map(str, got))
    assert leaked_items(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0
    other = leaked_items(spark.createDataFrame([("k'1", item)], "doc_id string, text string"), items.selectExpr("CAST(item_id AS smallint) AS item_id", "item_text"))
    assert [(r.doc_id, r.item_id) for r in other.collect()] == [("k'1", 1)] and dict(other.dtypes)["item_id"] == "smallint"
    assert leaked_items(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), items.limit(0)).count() == 0
