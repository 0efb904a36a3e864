"""Joins, decontamination, pages, search, licences, shards, scores and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lakeload.llm import ann, backoff_lm, components, decontaminate, html_extract, licenses, ngram_join, shards

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, node string, NOTE string, score double"


def words_of(seed, count, vocabulary=4000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(count)]


def edited(words, seed, changes):
    draw, out = random.Random(seed), list(words)
    for place in draw.sample(range(len(out)), changes):
        out[place] = f"e{draw.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def odd(spark):
    long = words_of(1, 30_000)
    base = words_of(2, 120)
    rows = [
        (1, " ".join(base)),
        (2, " ".join(edited(base, 1, 2))),
        (3, " ".join(edited(base, 2, 2))),
        (4, " ".join(edited(base, 3, 40))),
        (5, None),
        (6, ""),
        (7, None),
        (8, " \n\t "),
        (9, "one two"),
        (10, "One  TWO"),
        (10, "One  TWO"),
        (None, " ".join(base).upper()),
        (11, " ".join(long)),
        (12, " ".join(edited(long, 4, 50))),
        (13, "three"),
    ]
    return spark.createDataFrame([(i, t, "n", "N", 0.5) for i, t in rows], SCHEMA)


def plain_sets(rows):
    out = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
        out.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    return out


def plain_links(rows, similarity=0.8):
    sets, n = plain_sets(rows), len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            union = len(sets[a] | sets[b])
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / union >= similarity:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return sorted(((i, least.get(find(k), i), links[k]) for k, (i, _) in enumerate(rows)), key=repr)


def found_links(docs):
    found = ngram_join.near_duplicates(docs).select("doc_id", "class_id", "n_links").collect()
    return sorted((tuple(r) for r in found), key=repr)


def test_bands_reach_recall():
    for similarity in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.bands_for(similarity, 0.999)
        assert 1 - (1 - similarity**rows) ** bands >= 0.999


def test_join_equals_all_pairs(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found_links(odd) == plain_links(rows)
    assert found_links(odd.limit(0)) == []


def test_join_on_documents_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert found_links(docs) == plain_links([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    base = words_of(7, 60)
    rows = [(k, " ".join(edited(base, k, k % 3))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found_links(docs) == plain_links(rows)


def test_one_per_class(odd):
    kept = ngram_join.one_per_class(odd, ngram_join.near_duplicates(odd))
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None))
    assert ids == [4, 5, 6, 7, 8, 9, 11, 13]


def test_components_of_chains_and_stars(spark):
    draw = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)]
    edges += [(1000 + draw.randrange(300), 1000 + draw.randrange(300)) for _ in range(200)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in found} == {x: find(x) for x in root if find(x) != x}


def plain_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_equals_plain_table():
    draw = np.random.default_rng(1)
    for _ in range(100):
        a, b = (draw.integers(0, 4, draw.integers(1, 15)).astype(np.uint64) for _ in range(2))
        assert decontaminate.align(a, b)[0] == plain_alignment(a.tolist(), b.tolist())


def test_contamination_equals_aligning_everything(spark):
    items = [(k, " ".join(words_of(100 + k, 30))) for k in range(8)] + [(20, None), (21, ""), (22, "one two three")]
    around, rows = words_of(50, 400), []
    for k in range(8):
        item = items[k][1].split()
        rows.append((k, " ".join(around[:50] + item + around[50:90])))
        rows.append((100 + k, " ".join(around[:9] + edited(item, k, 7) + around[:40])))
        rows.append((200 + k, " ".join(around[k : 300 + k])))
        rows.append((300 + k, " ".join(around[:20] + item[:6] + around[40:60])))
        rows.append((400 + k, " ".join(item[:15] + ["x", "y"] + item[15:]).upper() + "!"))
    rows += [(500, None), (501, ""), (0, rows[0][1]), (None, items[0][1]), (502, "Say: one, two, three."), (503, "one two")]
    rows = [(i, t, "n", "N", 1.0) for i, t in rows]
    docs = spark.createDataFrame(rows, SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    matches = decontaminate.contaminated(docs, benchmark)
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in matches.collect()}
    wanted = {}
    split = re.compile(r"\w+").findall
    for doc_id, text, *_ in rows:
        for item_id, item in items:
            item, words = split((item or "").lower()), split((text or "").lower())
            if not item or not words:
                continue
            score, n = plain_alignment(item, words) / (2 * len(item)), min(4, len(item))
            seeds = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}
            runs = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            if score >= decontaminate.THRESHOLD and runs & seeds:
                wanted[doc_id, item_id] = score
    assert found == wanted and len(found) > 16
    clean = decontaminate.without_contaminated(docs, matches)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in wanted}
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="</p><article>";</script></head><body>'
    '<nav><ul><li><a href="/x">menu</a></ul></nav><div class="cookie-notice">Accept</div>'
    "<article><header>By us</header><h1>Title &lt;1&gt;</h1><p><b>First&nbsp; line<br>more<p>Second\n  <i>par</i>t"
    '<div class="ad">Buy</div><aside>Side</aside><form><p>Name</p></form><!-- <p>no</p> --><p title="a>b">Third'
    '</article><section id="comments"><p>I disagree</p></section><footer>&copy; us</footer></body></html>'
)


def test_text_of_one_page():
    text = html_extract.main_text(PAGE)
    assert text == "Title <1>\nFirst line more\nSecond part\nThird"
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("<p>a<p>b < c &amp; d<td>x") == "a\nb < c & d x"
    assert html_extract.main_text("just text") == "just text"
    inner = '<article class="with-sidebar"><p>Text</p></article>'
    comment = '<section id="comments"><article>No</article></section>'
    for page in (f'<body class="has-menu"><div class="with-sidebar">{inner}</div>', f"<body>{inner}{comment}"):
        assert html_extract.main_text(page) == "Text"


def test_odd_markup_is_linear():
    for piece in ("<", "<a ", '<a "', "<div>", "</div>", "<p>", "<!--", "&amp", "<script>", "<b><p>"):
        html_extract.main_text(piece * 20_000)


def test_templates_are_deleted_per_host(spark):
    def page(k, host):
        body = f'<div class="box"><span>Follow {host}</span></div><div><p>text {k} of it</p></div><div>{host} end</div>'
        return k, f"https://{host}.example.org/{k}", f"<html><body>{body}</body></html>"

    rows = [page(k, "a") for k in range(12)] + [page(100 + k, "b") for k in range(3)]
    rows += [(200 + k, "https://c.example.org/1", "<body><div>same copy</div></body>") for k in range(30)]
    rows += [(300, None, rows[0][2]), (301, "https://a.example.org/9", None), (0, *rows[0][1:])]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, TEXT string")
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()]
    wanted = [(k, f"text {k} of it") for k in (*range(12), 0)]
    wanted += [(100 + k, f"Follow b\ntext {100 + k} of it\nb end") for k in range(3)]
    wanted += [(200 + k, "same copy") for k in range(30)] + [(300, "Follow a\ntext 0 of it\na end"), (301, "")]
    assert sorted(found) == sorted((k, t, len(t)) for k, t in wanted)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_pages_equal_their_articles(spark):
    import html

    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    text = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for row in pages.collect():
        body = re.search(r"<article>(.*)</article>", row["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert text[row["page_id"]] == "\n".join(b for b in blocks if b)


def plain_search(rows, k=5):
    usable = {}
    for vec_id, vector in rows:
        if vec_id is not None and vector and None not in vector and np.isfinite(vector).all() and np.any(vector):
            usable[vec_id] = np.array(vector, float)
    out = {}
    for query in usable:
        if query % 50 == 0:
            scored = sorted((-ann.cosine(usable[query], v), i) for i, v in usable.items() if i != query)
            out[query] = [(i, -s) for s, i in scored[:k]]
    return out


def found_search(vectors):
    out = {}
    for row in sorted(ann.search(vectors).collect()):
        out.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
        assert len(out[row["query_id"]]) == row["rank"]
    return out


def test_search_recall_on_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    wanted = plain_search([tuple(r) for r in vectors.collect()])
    found = found_search(vectors)
    assert wanted.keys() == found.keys() and all(len(v) == 5 for v in found.values())
    hits = sum(len(set(dict(wanted[q])) & set(dict(found[q]))) for q in wanted)
    assert hits >= 0.9 * sum(map(len, wanted.values()))


def test_search_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    draw = np.random.default_rng(3)
    rows = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(100, 160)] + [(k, draw.normal(size=4).tolist()) for k in range(60)]
    rows += [(200, None), (250, [0.0] * 4), (300, [1.0, None, 2.0, 3.0]), (350, [math.nan, 1.0, 1.0, 1.0]), (400, [])]
    rows += [(None, [1.0] * 4), (100, [1.0, 2.0, 3.0, 4.0]), (450, [2.0, 4.0, 6.0, 8.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumnRenamed("x", "y")
    found, wanted = found_search(vectors), plain_search(rows)
    assert found.keys() == wanted.keys() == {0, 50, 100, 150, 450}
    for query in (100, 150):  # copies first, by id
        assert [i for i, _ in found[query]] == [i for i in range(100, 106) if i != query][:5]
    assert all(len(v) == 5 for v in found.values())
    few = spark.createDataFrame([(50, [1.0, 0.0]), (51, [0.0, 1.0])], vectors.schema)
    assert found_search(few) == {50: [(51, 0.0)]}
    assert found_search(vectors.limit(0)) == {}


def test_licences_equal_sql(spark, odd):
    base = duckdb.connect()
    for docs in (spark.read.parquet(f"{SF_DIR}/documents.parquet"), licence_rows(spark)):
        base.register("documents", docs.toArrow())
        wanted = base.execute(licenses.oracle_sql()).fetchall()
        found = [tuple(r) for r in licenses.scan(docs).collect()]
        assert sorted(found, key=repr) == sorted(wanted, key=repr) and found
    assert licenses.scan(odd).count() == 0


def licence_rows(spark):
    mit = licenses.TEMPLATES[5][1]
    rows = [(1, None), (2, ""), (3, mit), (3, mit), (None, f"intro\n{mit.upper()}\nend"), (5, mit.replace("free", "paid"))]
    rows += [(6, "licensed"), (7, "x " * 50_000), (8, "Released under THE mit-license\nor not"), (9, "\n\n")]
    return spark.createDataFrame([(i, t, "m", 1) for i, t in rows], "doc_id bigint, text string, license string, line int")


def test_permutation_is_one_to_one():
    for count in (1, 2, 3, 5, 64, 65, 1000, 4097):
        order = shards.Permutation(count, 12345)
        slots = order.slot(np.arange(count))
        assert sorted(slots.tolist()) == list(range(count))
        assert (order.sequence(slots) == np.arange(count)).all()
    assert (shards.Permutation(1000, 1).slot(np.arange(1000)) != shards.Permutation(1000, 2).slot(np.arange(1000))).any()


def test_shards_round_trip_and_resume(spark, odd, tmp_path, small_splits):
    small_splits(60_000)
    odd.repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    folder = f"{tmp_path}/out"
    rows = shards.write_shards(docs, folder, 7, 64, 100).collect()
    stream = b"".join((r["text"] or "").encode() + b"\xff" for r in docs.collect())
    count = -(-len(stream) // 64)
    assert sorted(r["slot"] for r in rows) == list(range(count))
    grid = shards.read_slots(folder, 0, count, 64, 100)
    by_sequence = grid[shards.Permutation(count, 7).slot(np.arange(count))].tobytes()
    assert by_sequence.rstrip(b"\xfe") == stream
    assert (shards.read_slots(folder, 150, 120, 64, 100) == grid[150:270]).all()
    for row in rows:
        assert row["crc32"] == zlib.crc32(grid[row["slot"]].tobytes())
        assert row["place"] == (row["slot"] - 100 * row["shard"]) * 64
    ids = [i for r in sorted(rows) for i in r["doc_ids"]]
    assert ids == [-1 if r["doc_id"] is None else r["doc_id"] for r in docs.collect()]
    # a second run keeps whole files and mends broken ones
    files = sorted((tmp_path / "out").glob("shard-*.bin"))
    files[0].write_bytes(b"broken")
    before = files[1].stat().st_mtime_ns
    assert sorted(shards.write_shards(docs, folder, 7, 64, 100).collect()) == sorted(rows)
    assert (shards.read_slots(folder, 0, count, 64, 100) == grid).all() and files[1].stat().st_mtime_ns == before
    assert shards.write_shards(docs.limit(0), f"{tmp_path}/none").count() == 0


def test_shards_of_token_ids(spark, tmp_path):
    rows = [(k, [(k * 7 + i) % 50_000 for i in range(k % 90)] if k % 5 else None) for k in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, ids array<int>").repartition(3).write.parquet(f"{tmp_path}/ids")
    docs, kind = spark.read.parquet(f"{tmp_path}/ids"), shards.Tokens("ids", 2, 50_256, 50_257)
    found = shards.write_shards(docs, f"{tmp_path}/out", 3, 32, 50, kind).collect()
    stream = [i for r in docs.collect() for i in [*(r["ids"] or []), 50_256]]
    count = -(-len(stream) // 32)
    grid = shards.read_slots(f"{tmp_path}/out", 0, count, 32, 50, 2)
    ordered = grid[shards.Permutation(count, 3).slot(np.arange(count))].reshape(-1).tolist()
    assert ordered[: len(stream)] == stream and set(ordered[len(stream) :]) <= {50_257}
    assert sorted(r["slot"] for r in found) == list(range(count))


def plain_scores(rows, order, a):
    tokens = {}
    train = Counter()
    follow = Counter()
    split = re.compile(r"[^\x20\x09-\x0D]+").findall
    for k, (doc_id, text) in enumerate(rows):
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        tokens[k] = ["<s>", *split(lowered), "</s>"]
        if zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 != 2:
            for i in range(1, len(tokens[k])):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        gram = tuple(tokens[k][i - n + 1 : i + 1])
                        train[gram] += 1
                        follow[gram[:-1]] += 1
    total, types = follow[()], len([g for g in train if len(g) == 1])

    def chance(history, word):
        if not history:
            return (train[(word,)] + 1) / (total + types + 1)
        lower = chance(history[1:], word)
        if not follow[history]:
            return lower
        return (train[(*history, word)] + a * lower) / (follow[history] + a)

    out = []
    for k, (doc_id, _) in enumerate(rows):
        own = tokens[k]
        base = sum(math.log10(chance((), w)) for w in own[1:])
        full = sum(math.log10(chance(tuple(own[max(0, i - order + 1) : i]), own[i])) for i in range(1, len(own)))
        known = sum((w,) in train for w in own[1:])
        held = zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2
        out.append((doc_id, held, len(own) - 1, known, total, base, full))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_model(spark, odd, order, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(backoff_lm, "SHARD_NGRAMS", 2000)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").limit(40)
    docs = odd.select("doc_id", "text").unionByName(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = sorted((tuple(r) for r in backoff_lm.score(docs, order).collect()), key=lambda r: (str(r[0]), r[2]))
    wanted = sorted(plain_scores(rows, order, backoff_lm.CONCENTRATION), key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in wanted], rtol=1e-10)


def test_model_beats_base_on_held_out(spark):
    found = backoff_lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    held = found[found["held_out"]]
    assert len(held) and held["score"].sum() > held["base_score"].sum()
    assert backoff_lm.score(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_pipeline_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "near_duplicates"
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, SF_DIR).cache()
        if name != "tokens":
            assert kept.columns == docs.columns
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            wanted = {(c if links else i) for i, c, links in plain_links(rows)}
            assert {r["doc_id"] for r in kept.collect()} == wanted
        if name in ("personal_data", "tokens"):
            assert kept.count() == before.count()
    final = kept.collect()
    assert 0 < len(final) < docs.count() and all(r["round_trip"] for r in final)
    assert all(r["n_chars"] == len(r["text"]) for r in final)


def test_pipeline_takes_odd_rows(spark, odd):
    docs = odd.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", "1 AS IDS")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF_DIR)
        assert out.columns == [*docs.columns, "ids_", "round_trip"]
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}
