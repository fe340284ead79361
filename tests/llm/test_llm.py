import hashlib
import io
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from caseloom.llm import ann, chat, decontaminate, mixing, ngram_join, quality, queries, secrets, substring_dedup, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, extra int"
WORDS = [f"w{i}" for i in range(60)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id."""
    return docs(spark, [(1, None), (2, ""), (3, " ".join(WORDS)), (3, " ".join(WORDS)), (4, " ".join(WORDS[:-1] + ["x"])), (5, "one two"), (6, "ONE  two"), (None, "null id"), (7, "word " * 50_000), (8, " \n\t")])


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def brute_components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    p = list(range(len(rows)))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * o >= num * len(sets[i] | sets[j]):
                p[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[root(i)] = min(d, first.get(root(i), d))
    return sorted(((d, len(sets[i]), first.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_jaccard_components_against_brute_force(spark, odd, empty):
    rng = np.random.default_rng(1)
    base = [[f"t{x}" for x in rng.integers(0, 3000, n)] for n in (5, 9, 12, 14, 20, 22, 40, 120)]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for b in base:
        for e in range(6):
            t = list(b)
            for at in rng.integers(0, len(t), e // 2):
                t[at] = f"e{rng.integers(0, 9)}"
            rows.append((len(rows) + 10, " ".join(t)))
    for k, num in ((4, 85), (5, 80)):
        got = ngram_join.jaccard_components(docs(spark, rows), k, num, 100).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_components(rows, k, num, 100)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_one_row_of_each_group_stays(spark, odd):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(9, a), (2, a), (2, a), (None, a), (None, b), (None, b), (4, c), (5, c), (5, d), (6, None), (6, None), (None, "")]
    got = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(2, a), (None, b), (4, c), (5, d), (6, None), (6, None), (None, "")], key=repr)
    assert sorted(r["doc_id"] or 0 for r in ngram_join.one_of_each(odd).collect()) == [0, 1, 2, 3, 5, 7, 8]


def test_light_sets_meet_in_a_subset():
    for n in range(1, 20):
        for m in range(1, n + 1):
            if 100 * m >= 85 * n:
                o = ngram_join.min_overlap(n, m, 85, 100)
                assert (n, m, o) in ngram_join.subset_plan(n, 19, 85, 100) and 185 * o >= 85 * (n + m) > 185 * (o - 1)


def test_leaks(spark, odd, empty):
    bench = spark.createDataFrame([(1, "The quick, brown fox jumps over the lazy dog near the river bank today"), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    item = "THE QUICK brown fox jumps over the lazy dog near the river bank today"
    near = item.replace("THE QUICK", "a quick")
    d = docs(spark, [(1, f"before {item} after"), (2, item), (3, "clean text about a quick brown fox"), (4, "Two words!"), (5, "two words and more"), (6, f"x {near} y"), (7, None)])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 4), (6, 1)}
    assert got == {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, bench, block_bytes=40).collect()}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(d, bench).collect()) == [3, 5, 7]
    assert decontaminate.find_leaks(odd, bench).count() == 0 and decontaminate.decontaminate(odd, bench).count() == 10
    assert decontaminate.find_leaks(d, bench.where("item_id < 0")).count() == 0 and decontaminate.decontaminate(empty, bench).count() == 0


def brute_leaks(texts, items, similarity=0.8):
    """(doc, item) whose best window of the item's size reaches the similarity, by counting shingles in plain Python."""
    fold = {c: c + 32 for c in (*range(65, 91), *range(0xC0, 0xDF)) if c != 0xD7}

    def shingles(text):
        w = re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").translate(fold))
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []

    bags, out = {i: Counter(shingles(t)) for i, t in items.items()}, set()
    for d, t in texts.items():
        h = shingles(t)
        for i, bag in bags.items():
            if not bag or not bag.keys() & set(h):
                continue
            n = min(bag.total(), len(h))
            for a in range(len(h) - n + 1):
                low = (Counter(h[a : a + n]) & bag).total()
                if low >= similarity * (n + bag.total() - low) - 1e-9:
                    out.add((d, i))
                    break
    return out


def test_leak_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts, items = ({r[0]: r[1] for r in spark.read.parquet(f"{sf}/{n}.parquet").select(k, "text").collect()} for n, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = decontaminate.op1_benchmark_decontamination(spark, sf).collect()
    want = brute_leaks(texts, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
    assert len(got) == len(want) and all(r["start_char"] < r["end_char"] <= len(texts[r["doc_id"]]) for r in got)


def test_hamming_blocks_miss_nothing():
    rng = np.random.default_rng(3)
    ix = decontaminate.Index([(i, " ".join(f"a{x}" for x in rng.integers(0, 500, 20))) for i in range(50)], 0.8, 24)
    for _ in range(300):
        f = int(ix.print[int(rng.integers(50))]) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 30)), False))
        assert dict(ix.within(16, f)) == {i: (f ^ p).bit_count() for i, p in enumerate(ix.print.tolist()) if (f ^ p).bit_count() <= 24}
    assert ix.within(15, 0) == []


def test_mixing_meets_targets(spark, odd, empty):
    t, codes = np.array([50.0, 10, 20, 20]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    w = mixing.rake(t, codes, [np.array([0.5, 0.5]), np.array([0.3, 0.7])])
    assert np.allclose(np.bincount(codes[0], w), 0.5) and np.allclose(np.bincount(codes[1], w), [0.3, 0.7])
    p = mixing.calibrate(t, w, 60)
    assert np.isclose((p * t).sum(), 60) and p.max() <= 1
    d = spark.read.parquet(f"{SF}/documents.parquet")
    small, large = ({r["doc_id"]: r["mix_p"] for r in mixing.mix(d, mixing.TARGETS, max_cells=m).collect()} for m in (10, 10_000))
    assert small.keys() == large.keys() and all(abs(p - large[i]) < 1e-4 for i, p in small.items())
    assert mixing.mix(empty, mixing.TARGETS).count() == 0
    got = mixing.with_tokens(odd).collect()
    assert all(r["tokens"] == len((r["text"] or "").split()) for r in got)
    assert {r["doc_id"] for r in mixing.mix(odd, mixing.TARGETS, fraction=1.0).collect()} == {3, 4, 5, 6, None, 7}


def test_tables_are_raked_as_far_as_arrays(spark):
    n = {("a", "en"): 30, ("a", "de"): 10, ("b", "en"): 10, ("b", "de"): 30}
    d = spark.createDataFrame([(i, "a " * k, lang, src, 1) for i, ((src, lang), k) in enumerate(n.items())], DOCS)
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.8, "de": 0.2}, "topic": 1.0}
    tables, arrays = ({r["doc_id"]: r["mix_weight"] for r in mixing.mix(d, targets, fraction=1.0, max_cells=m).collect()} for m in (0, 100))
    assert len(arrays) == 4 and tables == pytest.approx(arrays, rel=0, abs=1e-9)


def test_unlisted_values_keep_their_share(spark):
    d = spark.createDataFrame([(i, "a b c d e", lang, "s", 1) for i, lang in enumerate(["en"] * 4 + ["de"] * 2 + [None] * 2 + ["xx"] * 2)], DOCS)
    for lang, want in (({"en": 0.6, "de": 0.2, "fr": 0.2}, {"en": 0.45, "de": 0.15, None: 0.2, "xx": 0.2}), ({"en": 0.0}, {"de": 1 / 3, None: 1 / 3, "xx": 1 / 3}), ({}, {"en": 0.4, "de": 0.2, None: 0.2, "xx": 0.2})):
        for cells in (0, 100):
            got = {r["lang"]: r["mix_weight"] for r in mixing.mix(d, mixing.TARGETS | {"lang": lang}, fraction=1.0, max_cells=cells).collect()}
            assert got == pytest.approx(want)


def test_chat_round_trip(spark):
    texts = ["", "\\", "<|im_start|>", "<\\|im_end|>\n", "</s>[INST] ok [/INST]", "é<s>", "\\\\<<SYS>>", None, "a" * 1000]
    turns = [(1, i, ["user", "assistant", "<|message|>"][i % 3], t) for i, t in enumerate(texts)] + [(None, None, None, "x"), (1, 3, "user", "tie"), (1, 3, "user", "tie")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chunks = chat.format_chats(df)
    got = {c: [x for r in sorted(chunks.collect(), key=lambda r: r["chunk"]) if r["conv_id"] == c for x in chat.parse(r["text"].encode())] for c in (1, None)}
    want = sorted([(t, r or "", x or "") for c, t, r, x in turns if c == 1])
    assert [(a.decode(), b.decode()) for a, b in got[1]] == [(r, x) for _, r, x in want] and got[None] == [(b"", b"x")]
    assert {tuple(r) for r in chat.read_chats(chunks).collect()} == {tuple(r) for r in chat.read_chats(chunks, ordered=True).collect()}
    assert chat.format_chats(df.limit(0)).count() == 0


def split_units(text):
    """(start, end, words) of lines and, in them, of sentences: character by character, apart from the operator's regex."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        end = at + 1
        while end < len(text) and text[end] != "\n" and not (text[end - 1] in ".!?" and text[end].isspace()):
            end += 1
        out.append((at, at + len(text[at:end].rstrip()), tuple(text[at:end].casefold().split())))
        at = end
    return out


def brute_dedup(rows, min_words):
    """(doc_id, text) -> clean text: every unit in a run that an earlier text or place holds goes."""
    seen, out = set(), []
    for _, t in sorted(rows, key=lambda r: r[0]):
        units, gone = split_units(t or ""), set()
        for i in range(len(units)):
            j = i
            while j >= 0 and sum(len(u[2]) for u in units[j : i + 1]) < min_words:
                j -= 1
            if j < 0:
                continue
            run = tuple(u[2] for u in units[j : i + 1])
            if run in seen:
                gone |= set(range(j, i + 1))
            seen.add(run)
        kept, at = "", 0
        for i in sorted(gone):
            s, e, _ = units[i]
            kept += t[at:s] if s >= at else ""
            at = e
            while at < len(t) and t[at].isspace():
                at += 1
        out.append(kept + t[at:] if t else t)
    return out


def test_substring_dedup_against_brute_force(spark, odd, empty):
    passage = "a passage of quite some words that repeats. it has a second sentence as well! then one more, which is not so short."
    lines = "\n".join(f"line {i}" for i in range(40))
    rows = [
        (1, f"Own beginning of the first text here. {passage} end"), (2, f"another beginning, which differs\n{passage.upper()}\nand an end"), (3, "short one."), (4, "nothing repeated in this text at all."),
        (5, None), (6, ""), (7, lines), (8, f"Title\n{lines}"), (9, "WORD!! " * 60), (10, "WORD!! " * 60), (11, f"spliced {passage} into a sentence"), (12, "x. y? " * 9 + passage),
        (13, "Is it v1.2?  yes.no! done"), (14, f"{passage} {passage}"),
    ]
    for n in (5, 12, 20):
        got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs(spark, rows), n).collect()}
        assert [got[i]["clean_text"] for i, _ in rows] == brute_dedup(rows, n)
        for i, t in rows:
            spans = [tuple(x) for x in got[i]["removed_spans"]]
            assert substring_dedup.cut(t, spans) == got[i]["clean_text"] if t else not spans
            assert got[i]["n_removed"] == len(spans) and got[i]["removed_chars"] == sum(e - s for s, e in spans)
    assert got[2]["clean_text"].split() == "another beginning, which differs and an end".split() and got[2]["kept_doc_ids"] == [1]
    assert got[8]["clean_text"] == "Title\n" and got[10]["clean_text"] == "" and got[14]["clean_text"] == "" and got[3]["clean_text"] == "short one."
    assert substring_dedup.dedup_substrings(odd).count() == 10 and substring_dedup.dedup_substrings(empty).count() == 0


def test_dedup_query_against_brute_force(spark):
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = substring_dedup.op4_substring_dedup(spark, SF).collect()
    assert len(got) == len(want) and [r["text"] for r in sorted(got, key=lambda r: r["doc_id"])] == brute_dedup(want.items(), 20)
    assert any(r["n_removed"] for r in got) and not all(r["n_removed"] for r in got)


def test_classifiers_edge_cases(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, 0), (4, 1, 1), (5, 0, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (3, 0, 1)], none.schema)
    for f in (quality.score_quality, toxicity.score_toxicity):
        for lab in (none, some):
            got = f(odd, lab).collect()
            assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got) and f(empty, lab).count() == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in quality.score_quality(odd, none).collect() if r["doc_id"])
    assert quality.keep_good(odd, none).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    for f, label in ((quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")):
        got = f(d, lab).where("held_out").join(lab, "doc_id").select("predicted", label).collect()
        assert np.mean([a == b for a, b in got]) > 0.88


def test_warc_reads_back_and_verifies(spark, tmp_path):
    big = "<p>é</p>" * 3000
    pages = spark.createDataFrame([(3, "u 3\n", big), (1, "u1", big), (2, None, None), (5, "u5", "short"), (6, "u6", "short"), (None, "n", big)], "page_id long, url string, html string")
    out = warc.read_warcs(warc.write_warcs(pages, f"file://{tmp_path}/w", file_bytes=200), keep_payload=True).collect()
    by = {r["page_id"]: r for r in out}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in by.items()} == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 1)}
    assert by[1]["html"] == big and by[3]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest() and by[3]["url"] == "u 3\n"
    good = warc.record(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None, "d")
    raw = zlib.decompress(good, 31)
    for bad in (raw.replace(b"xxx", b"xxy", 1), raw[:-9], raw.replace(b"Content-Length: 2", b"Content-Length: 3")):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(z.compress(bad) + z.flush())))
    assert warc.read_warcs(warc.write_warcs(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_secrets(spark, odd, empty):
    key, sec = "AKIA" + "ABCDEFGHIJKL2345", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    rows = [(1, f"é PassWord: 'longenough1' {key} {sec} at https://h.example/x"), (2, f"{sec} alone https://h.example/x"), (3, "password=token: abcdefgh1 secret=short"), (4, f"{key} https://h.example/x"), (5, f"{key}{' ' * 2000}{sec}"), (6, "f" * 40 + " token=" + "0" * 32)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan_secrets(docs(spark, rows)).collect()}
    assert [k for k, _, _ in got[1]] == ["assign", "access", "secret", "endpoint"] and rows[0][1][got[1][2][1] : got[1][2][2]] == sec
    assert got[2] == [] and got[3] == [] and [k for k, _, _ in got[4]] == ["access"] and [k for k, _, _ in got[5]] == ["access"]
    assert got[6] == [("hex", 0, 40), ("assign", 41, 79), ("hex", 47, 79)]
    text = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs(spark, rows)).collect()}
    assert text[1] == "é [assign]' [access] [secret] at [endpoint]" and text[2] == rows[1][1]
    assert secrets.redact_secrets(odd).count() == 10 and secrets.scan_secrets(odd).count() == 10 and secrets.scan_secrets(empty).count() == 0


@pytest.mark.parametrize("form", ["AWS_SECRET_ACCESS_KEY={}", "it is {}.", "https://h.example/?sk={}", "key_{}_", "{}=", "v-{}-w", "({})", "{}.Next"])
def test_secret_beside_any_other_character(spark, form):
    key, sec = "AKIA" + "ABCDEFGHIJKL2345", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    d = docs(spark, [(1, f"AWS_ACCESS_KEY_ID={key}\n{form.format(sec)}\nsee https://e.example/y"), (2, f"{key} {form.format('a' + sec)}"), (3, f"{key} {form.format(sec + '/')}")])
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan_secrets(d).collect()}
    at = d.where("doc_id = 1").first()["text"].index(sec)
    assert ("secret", at, at + 40) in got[1] and got[1][-1][0] == "endpoint"
    assert not {"secret", "endpoint"} & {k for i in (2, 3) for k, _, _ in got[i]}
    assert sec not in secrets.redact_secrets(d).where("doc_id = 1").first()["text"]


def brute_spans(text):
    """Base spans by Python's re."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = secrets.op9_secret_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts) and any(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got)
    for r in got:
        base = brute_spans(texts[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= {*r["spans"].split(","), ""}
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, _, k, _ in base) for x in ("assign", "access", "hex"))


def test_secrets_of_a_long_text(spark):
    """16,000 matches in half a megabyte, beside access identifiers and endpoints."""
    part = "".join(f"{i:032x} " for i in range(15_000))
    text = part + "".join(f"é AKIA{i:016d} {'aB3' * 13}x https://h.example/{i} " for i in range(500))
    d = docs(spark, [(1, text)])
    got = secrets.scan_secrets(d).first()
    assert (got["n_hex"], got["n_access"], got["n_linked"]) == (15_000, 500, 1000)
    assert [tuple(s) for s in got["spans"] if s["rank"] < 3] == brute_spans(text)
    clean = secrets.redact_secrets(d).first()["text"]
    assert clean == "[hex] " * 15_000 + "é [access] [secret] [endpoint] " * 500


def test_extra_columns_with_clashing_names(spark):
    names = ["_key", "_many", "_id", "_hash", "_h", "_spans", "_kept", "_row", "_u", "_cell_source", "c0", "row", "linked", "clean_text", "tokens", "_dedup_id", "_text", "n", "component_id"]
    a, b = "some words of a text that is long enough to be found again in here, twenty of them at the least, yes", "AKIA" + "ABCDEFGHIJKL2345 password=longenough1 https://h.example/x and 7 more words"
    rows = [(i, t, "en", "s", *range(len(names))) for i, t in enumerate((a, a, b, None, "", a.upper()))]
    d = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {', '.join(f'{n} int' for n in names)}")
    bench = spark.createDataFrame([(1, "no such item in any of these texts at all")], "item_id long, text string")
    for out, n in ((ngram_join.one_of_each(d), 4), (decontaminate.decontaminate(d, bench), 6), (secrets.redact_secrets(d), 6), (substring_dedup.dedup_substrings(d), 6), (mixing.mix(d, mixing.TARGETS, fraction=1.0), 4)):
        got = out.collect()
        assert len(got) == n and all(r["_id"] == 2 and r["_u"] == 8 and r["c0"] == 10 and r["_key"] == 0 and r["linked"] == 12 for r in got)


def test_few_queries_never_come_up_short(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1600, 8)) * 0.01
    x[:5] = 50 + 30 * rng.normal(size=(5, 8))
    x[100:400] = x[100]
    for parts in (256, 4):
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows_per_part=100, max_parts=parts, block=300).collect()
        by = {}
        for r in got:
            by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert set(by) == set(range(0, 1600, 100)) and all([k for k, _, _ in sorted(v)] == list(range(1, 11)) for v in by.values())
        same = [i for i in range(100, 112) if i != 100][:10]
        assert [i for _, i, _ in sorted(by[100])] == same and [i for _, i, _ in sorted(by[200])] == list(range(100, 110))
    few = ann.search(spark.createDataFrame([(i, x[i].tolist()) for i in range(4)], "vec_id long, embedding array<double>"), every=1).collect()
    assert len(few) == 12


@pytest.mark.parametrize("max_parts", [256, 6])
def test_neighbours_recall_and_edges(spark, max_parts):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0]), (None, x[0].tolist()), (7, x[7].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows_per_part=250 if max_parts == 256 else 100, max_parts=max_parts, block=200).collect()
    hit = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in sorted(mine, key=lambda r: (r["score"], r["vec_id"]))] == list(range(1, 11))
        assert all(r["score"] == d[r["vec_id"]] for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 400 and {r["query_id"] for r in got} == set(range(0, 4000, 100))
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("conversations", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(c.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE[name]})").fetchall(), key=repr)


def brute_mix(rows, targets, fraction=0.5, seed=17):
    """doc_id of the sampled rows, raked and calibrated with plain dictionaries."""
    cell, tokens = {}, Counter()
    for d, text, lang, source in rows:
        topic = next((name for name, marks in mixing.TOPICS if any(m in (text or "") for m in marks)), "prose")
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        cell[d] = (source or "", lang or "", topic)
        tokens[cell[d]] += n
    total = sum(tokens.values())
    shares = []
    for i, dim in enumerate(mixing.DIMS):
        t = Counter()
        for c, n in tokens.items():
            t[c[i]] += n
        raw = {v: targets[dim][v] for v in t} if isinstance(targets[dim], dict) else {v: n ** targets[dim] for v, n in t.items() if n}
        shares.append({v: x / sum(raw.values()) for v, x in raw.items()})
    w = {c: n / total for c, n in tokens.items()}
    for _ in range(200):
        for i, share in enumerate(shares):
            got = Counter()
            for c, x in w.items():
                got[c[i]] += x
            w = {c: x * share.get(c[i], 0) / got[c[i]] if got[c[i]] else 0 for c, x in w.items()}
    full, p = set(), {}
    while True:
        left, rest = fraction * total - sum(tokens[c] for c in full), sum(x for c, x in w.items() if c not in full)
        p = {c: 1.0 if c in full else left * x / rest / tokens[c] if tokens[c] else 0 for c, x in w.items()}
        more = {c for c, x in p.items() if x >= 1} - full
        if not more:
            break
        full |= more
    return {d for d, text, *_ in rows if (text or "").split() and int(hashlib.sha256(f"{d}:{seed}".encode()).hexdigest()[:12], 16) / (1 << 48) < p[cell[d]]}


def test_mixing_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert {r["doc_id"] for r in mixing.op2_source_mixing(spark, SF).collect()} == brute_mix(rows, mixing.TARGETS)


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages, held = dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES:
        d, before = stage(spark, d, SF), text(d)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert d.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        d = corpus_pipeline.materialize(d, "t")
        held[name] = before, text(d)
    before, after = held["quality classifier"]
    score = {r["doc_id"]: r["score"] for r in quality.op6_quality_classifier(spark, SF).collect()}
    assert after == {i: t for i, t in before.items() if score[i] >= 0.7}
    before, after = held["n-gram Jaccard join"]
    assert after == {i: before[i] for i, n, c in brute_components(sorted(before.items()), 5, 80, 100) if i == c}
    before, after = held["benchmark decontamination"]
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    gone = {i for i, _ in brute_leaks(before, items)}
    assert after == {i: t for i, t in before.items() if i not in gone}
    before, after = held["secret scans"]
    for i, t in before.items():
        out, at = "", 0
        for a, _, kind, b in brute_spans(t):
            if a >= at:
                out += f"{t[at:a]}[{kind}]"
            at = max(at, b)
        assert after[i] == out + t[at:]
    assert before.keys() == after.keys()
    before, after = held["mixing sources to target weights"]
    info = {r["doc_id"]: (r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert after.keys() == brute_mix([(i, t, *info[i]) for i, t in before.items()], mixing.TARGETS)
    out = corpus_pipeline.run(spark, SF)
    assert text(out) == after and stages.keys() == held.keys()


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    """Nulls, empty and long texts, repeated rows and null ids pass through every stage; empty tables stay empty."""
    import corpus_pipeline

    full = odd.withColumn("n_chars", odd["doc_id"])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, full, SF).collect()
        assert len(got) <= 10 and (name not in ("benchmark decontamination", "secret scans") or len(got) == 10), name
        assert stage(spark, empty.withColumn("n_chars", empty["doc_id"]), SF).count() == 0
