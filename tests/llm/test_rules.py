"""Quality rules, line dedup, URL rules, mixing, secrets: the operators that work row by row or by source."""

import hashlib
from collections import Counter

import brute
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credence.llm import common, line_dedup, mixing, oracles, queries, quality_rules, secret_scan, url_filter


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_matches_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(queries.queries()[name](spark, sf_dir), oracles.oracle_sql()[name])


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- quality rules

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "clean_text")


def test_quality_counts(odd_docs):
    got = Counter(rows_of(quality_rules.judge(odd_docs), "doc_id", *COUNTS))
    assert got == Counter((i, *brute.quality(t)) for i, t in rows_of(odd_docs, "doc_id", "text"))


def test_quality_clean(odd_docs, docs):
    for df in (odd_docs, docs):
        out = quality_rules.clean(df)
        assert out.columns == df.columns
        for words, out in ((50, out), (1, quality_rules.clean(df, min_words=1))):
            want = Counter((i, q[-1], s) for i, t, s in rows_of(df, "doc_id", "text", "source") if (q := brute.quality(t, words))[6])
            assert Counter(rows_of(out, "doc_id", "text", "source")) == want


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n.|!A", max_size=60), min_size=1, max_size=6))
def test_quality_on_small_alphabets(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(rows_of(quality_rules.judge(df), "doc_id", *COUNTS)) == [(i, *brute.quality(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(
    "line, fails",
    [
        ("one two three four five six seven eight", True), ("one two. three four five six seven eight nine ten", True), ("Here at 3.5 of example.com one two three four", True), ("one two three four five six seven eight.", False), ('She said "one two three four five six."', False), ("one two three four five six (seven eight.) ", False),
        ("one two three four five six seven. token = 9f14", False), ("一二三四五六七八。 a b c d e f g", False), ("one two three four five six seven", False), ("Todos los derechos reservados.", True), ("LIRE LA SUITE", True), ("Datenschutzerklärung.", True), ("home | news | about | contact", True), ("", False),
    ],
)
def test_line_rules(spark, line, fails):
    got = quality_rules.judge(spark.createDataFrame([(1, line)], "doc_id int, text string")).first()
    assert (got.lost_chars > 0) == fails == brute.line_fails(line)


def test_many_repeated_windows(spark):
    text = " ".join(f"w{i}" for i in range(300)) * 2  # more than a few windows found twice
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality_rules.judge(df).first().n_repeat_words == brute.quality(text)[4] > 500


# --- line dedup


def test_lines(odd_docs, docs):
    for df in (docs, odd_docs):
        for limits in ({}, {"max_ratio": 0.0, "min_pages": 1, "min_count": 2}):
            got = line_dedup.dedup_lines(df, **limits)
            assert got.columns == df.columns
            rows = rows_of(df, "source", "text", "doc_id")
            names = {"max_ratio": "ratio"}
            want = brute.dedup_lines([r[:2] for r in rows], **{names.get(k, k): v for k, v in limits.items()})
            assert Counter(rows_of(got, "source", "text", "doc_id")) == Counter((s, t, i) for (s, _, i), t in zip(rows, want))


def test_lines_on_hosts_of_all_sizes(spark):
    size = {"one": 1, "two": 2, "ten": 10, "nineteen": 19, "twenty": 20, "thirty": 30}
    on = {"both": 2, "all": 100, "three": 3, "four": 4}
    pages = [(h, i, "\n".join([f"{h} {i}", *(x for x, k in on.items() if i < k)])) for h, n in size.items() for i in range(n)]
    out = line_dedup.dedup_lines(spark.createDataFrame(pages, "source string, doc_id int, text string"), count_col="n")
    left = {h: Counter() for h in size}
    for h, t, n in rows_of(out, "source", "text", "n"):
        left[h].update(t.split("\n")[1:])
    everywhere = dict.fromkeys(on, 1)
    assert left == {"one": everywhere, "two": {}, "ten": {}, "nineteen": {}, "twenty": {"both": 2}, "thirty": {"both": 2, "three": 3}}


def test_lines_by_shuffle(docs, monkeypatch):
    limits = {"max_ratio": 0.0, "min_pages": 1, "min_count": 2}
    want = Counter(rows_of(line_dedup.dedup_lines(docs, **limits), "doc_id", "text"))
    monkeypatch.setattr(line_dedup, "small", lambda df: False)
    assert Counter(rows_of(line_dedup.dedup_lines(docs, **limits), "doc_id", "text")) == want


# --- URL filter


def test_url_parts():
    assert url_filter.split_url("HTTP://A.Example.NET:80/x/Y?q#f") == ("a.example.net:80", "/x/Y")
    assert url_filter.split_url("http://h?q=/a") == ("h", "") and url_filter.split_url("no scheme/x") == ("", "") == url_filter.split_url(None)


@pytest.mark.parametrize(
    "url, rule, verdict",
    [
        ("http://example.net/en/x", "example.net/en/", "allow"), ("http://a.example.net/de/x", "net/", "block"), ("http://example.net", None, "allow"), ("http://notexample.com/de/", None, "allow"), ("http://b.EXAMPLE.com/de/", "example.com/de/", "block"),
        ("http://example.com/DE/", None, "allow"), ("http://x.org/fr/", "org/fr/", "allow"), ("http://org/fr/?a", "org/fr/", "allow"), ("http://net.org/", None, "allow"), (None, None, "allow"), ("", None, "allow"),
        ("https://ads.doubleclick.net/x", "net/", "block"), ("https://x.com/adserver/1", None, "block"), ("https://archive.org/adserver/1", None, "allow"), ("https://x.com/file.torrent", None, "block"), ("https://x.com/file.torrent?x", None, "allow"),
    ],
)
def test_url_rules(url, rule, verdict):
    got = url_filter.Index(url_filter.rules(), {}).judge(url)
    assert (got[2], got[3]) == (rule, verdict)


def test_index_loses_no_rule(spark, sf_dir):
    """Trying all rules on every URL gives the same."""
    given_ = url_filter.rules()
    every = url_filter.Index([url_filter.Rule(r.name, r.verdict, r.by_host, r.regex) for r in given_], {})
    urls = [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()] + ["http://a.net/x", "x-net/", "http://q/xmlrpc.php", "http://googlesyndication.com.org/", "http://a/calendar/2/day/3", "http://h/x?SessionID=3"]
    for counts in ({}, {"net": 9, "example": 1, "com": 5}):
        index = url_filter.Index(given_, counts)
        assert [index.judge(u)[:5] for u in urls] == [every.judge(u)[:5] for u in urls]


def test_ten_thousand_rules(spark, tmp_path):
    """A generated list, read from a file: the indexed rules judge as trying all does, and few are tried."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    lines = ["! a comment", "", "# another"]
    for _ in range(10_000):
        host, path = f"{word()}.{rng.choice(['com', 'net', 'org'])}", f"/{word()}/{word()}"
        lines.append(rng.choice([f"{rng.choice(['block', 'allow'])} {host}{rng.choice(['', '/', path])}", f"||{host}^", f"{rng.choice(['', '@@'])}{path}/", f"/{word()}/*{word()}^", f"|http://{host}{path}", f".{word()}|"]))
    (tmp_path / "rules.txt").write_text("\n".join(lines))
    given_ = url_filter.load(spark.read.text(f"file://{tmp_path}/rules.txt"))
    assert [r.name for r in given_] == [line.removeprefix("block ").removeprefix("allow ") for line in dict.fromkeys(lines) if line and line[0] not in "!#"]
    urls = [f"{rng.choice(['http', 'https'])}://{word()}.{word()}.{rng.choice(['com', 'net', 'org'])}/{word()}/{word()}/{word()}.{word()}?{word()}" for _ in range(300)] + ["http://x/" + "a/" * 20_000, None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(df, given_).collect()}
    every = url_filter.Index([url_filter.Rule(r.name, r.verdict, r.by_host, r.regex) for r in given_], {})
    assert all(tuple(got[i])[1:6] == every.judge(u)[:5] for i, u in enumerate(urls))
    assert sum(r.n_tried for r in got.values()) < 0.03 * len(given_) * len(urls) and len({r.verdict for r in got.values()}) == 2
    with pytest.raises(ValueError):
        url_filter.load(spark.range(url_filter.MOST_RULES + 1).selectExpr("cast(id as string)"))


def test_urls_with_nulls(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "http://a.net/", 2), (1, None, 1)], "page_id long, url string, host int")
    assert sorted(rows_of(url_filter.judge(df), "page_id", "verdict"), key=repr) == [(1, "allow"), (1, "allow"), (None, "block")]
    assert url_filter.judge(df.limit(0)).count() == 0


# --- mixing


def test_mixing(odd_docs, docs):
    for df in (docs, odd_docs):
        rows = rows_of(df, "doc_id", "source", "text")
        got = mixing.mix(df)
        want = brute.mix(rows)
        assert Counter((r.row.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got.collect()) == Counter((i, n, s, round(t, 6), sum(p)) for (i, _, _), (n, s, t, p) in zip(rows, want))
        by_source = {}
        for r in got.collect():
            assert 0 <= r.taken <= 2 * r.size and all(0 <= c.position <= 1 for c in r.copies)
            by_source.setdefault(r.source, [r.target, 0])[1] += r.taken
        assert all(abs(t - k) <= 0.5 for t, k in by_source.values())


def test_curriculum_order(docs):
    got = mixing.mix(docs).select("size", "source_size", "target", F.explode("copies").alias("c")).collect()
    assert len({r.c.position for r in got}) > 100
    out = rows_of(mixing.schedule_documents(docs), "doc_id")
    want = Counter()
    for (i, _, _), (n, _, _, parts) in zip((rows := rows_of(docs, "doc_id", "source", "text")), brute.mix(rows)):
        want[i] += sum(p > 0 and 2 * p >= n for p in parts)
    assert Counter(i for (i,) in out) == +want


def test_every_source_with_a_target_stays_in_the_mix(spark):
    rows = [(1, "a", "w " * 4000), (2, "b", "w " * 100), (3, "b", "w " * 90), (4, "c", "w " * 9000), (5, "d", ""), (6, "e", "w " * 9000), (7, "e", "w " * 9000)]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string")
    how = {"weights": (1.0,), "share": 0.05}
    mixed = {r.source: r for r in mixing.mix(df, **how).collect()}
    assert 0 < mixed["c"].target < 4500 and 0 < mixed["a"].target < 2000  # under half of their only documents
    kept = Counter(rows_of(mixing.schedule_documents(df, **how), "source"))
    assert set(kept) == {("a",), ("b",), ("c",), ("e",)} and kept["e",] == 1


def test_positions_invert_the_schedule(spark):
    for s in mixing.SCHEDULES:
        df = spark.range(0, 101).select((F.col("id") / 100).alias("u"), mixing.position(F.col("id") / 100, s).alias("p"))
        mean = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(s, s[1:]))
        for r in df.collect():
            done = 0.0
            for a, b in zip(s, s[1:]):
                x = min(max(r.p - a[0], 0), b[0] - a[0])
                done += a[1] * x + (b[1] - a[1]) / (b[0] - a[0]) * x * x / 2
            assert done / mean == pytest.approx(r.u, abs=1e-9)


def test_ranks(spark):
    df = spark.createDataFrame([("b",), (None,), ("é",), ("a",)], "source string")
    assert {r.source: r._rank for r in mixing.ranked(df, "source").collect()} == {"a": 0, "b": 1, "é": 2, None: 3}


# --- secrets


def test_base_spans(odd_docs, docs):
    for df in (odd_docs, docs):
        got = secret_scan.scan(df).select("doc_id", F.filter("spans", lambda s: s["k"] < 3).alias("s"), "spans").collect()
        texts = Counter((i, brute.spelled(brute.secrets(t))) for i, t in rows_of(df, "doc_id", "text"))
        assert Counter((r.doc_id, brute.spelled([tuple(x) for x in r.s])) for r in got) == texts
        assert all(list(r.spans) == sorted(r.spans) for r in got)


def test_query_digest(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op9_secret_scan(spark, sf_dir).collect()}
    for i, t in rows_of(docs, "doc_id", "text"):
        spans = brute.secrets(t)
        assert got[i].base_sha256 == hashlib.sha256(brute.spelled(spans).encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for _, k, _ in spans) for x in range(3)]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["token", "Secret", "=", ":", " ", '"', "abc", "AKIA", "XYZ9", "0f", "😀", "\n", "."]), max_size=40).map("".join), min_size=1, max_size=5))
def test_spans_on_fragments(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secret_scan.scan(df).orderBy("doc_id").collect()
    assert [brute.spelled([tuple(s) for s in r.spans if s.k < 3]) for r in got] == [brute.spelled(brute.secrets(t)) for t in texts]


def test_many_secrets_in_one_text(spark):
    text = "x deadbeefdeadbeef0 " * 700  # more than one chunk of running sums
    got = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.end) for s in got.spans] == [(a, b) for a, _, b in brute.secrets(text)]


def test_battery_tells_random_from_words(spark):
    import random

    rng = random.Random(3)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    tokens = ["".join(rng.choice(b64) for _ in range(n)) for n in (24, 40, 64) for _ in range(100)]
    natural = ["internationalizationmechanism", "keitlichenlichkeitbeung", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz0123456789", "SomeVeryLongCamelCaseClassNameFactory"] * 60
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens + natural)], "doc_id long, text string")
    found = {r.doc_id for r in secret_scan.scan(df).filter(F.exists("spans", lambda s: s["k"] == 3)).collect()}
    assert len([i for i in found if i < 300]) > 250
    assert len([i for i in found if i >= 300]) < 0.15 * len(found)
    p = [r.p for r in df.filter("doc_id < 300").select(secret_scan.p_random(F.col("text"))["p"].alias("p")).collect()]
    assert 0.3 < sum(x > 0.5 for x in p) / 300 < 0.8


def test_battery_matches_sql(spark, tmp_path):
    """Random tokens of every encoding and length class among words, base spans and characters beyond the BMP."""
    import random

    import duckdb

    rng = random.Random(11)
    token = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    spellings = [*secret_scan.ALPHABETS, "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", secret_scan.ALPHABETS[3].replace("+/", "-_")]
    texts = []
    for i in range(900):
        parts = [rng.choice(["é 😀", "plain words here", "token = ", "AKIA", "x"]) for _ in range(3)]
        parts.append(token(rng.choice(spellings), rng.choice([19, 20, 24, 33, 40, 64, 100, 200])) + "=" * rng.randint(0, 3))
        parts.append(rng.choice(["keitlichenlichkeitbeung", "a" * 30, "SomeVeryLongCamelCaseClassNameFactory", "abcdefghijklmnopqrstuvwxyz0123456789"]))
        rng.shuffle(parts)
        texts.append(rng.choice([" ", " ", "\n"]).join(parts))
    df = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op9_secret_scan(spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows_of(got.orderBy("doc_id"), *got.columns) == con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.secrets()}) ORDER BY doc_id").fetchall()
    assert got.agg(F.sum("n_random")).first()[0] > 200 and got.filter("n_assign > 0").count() > 50


def test_thresholds():
    uniform = [(1, b, 10) for b in range(50)]
    assert secret_scan.thresholds(uniform) == {1: secret_scan.LEAST_P}
    words = [(2, 0, 1000), (2, 3, 200), *[(2, b, 2) for b in range(4, 50)]]
    assert secret_scan.thresholds(words)[2] == pytest.approx(0.08)
    assert secret_scan.thresholds([(3, 1, 50)]) == {}


# --- all of them


def test_empty_tables(no_docs):
    for out in (quality_rules.judge(no_docs), quality_rules.clean(no_docs), line_dedup.dedup_lines(no_docs), mixing.mix(no_docs), mixing.schedule_documents(no_docs), secret_scan.scan(no_docs)):
        assert out.collect() == []


def test_shared_folder_is_the_session_setting(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

