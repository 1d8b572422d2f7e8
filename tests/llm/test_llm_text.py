"""Extraction, filters, scores, archives, decontamination, personal data, chat: brute force and edge cases."""

import collections
import hashlib
import html
import io
import itertools
import math
import random
import re
import struct
import time

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import compare, duck
from skimdex.llm import chat, decontaminate, html_text, pii, quality, queries, url_rules, warc

DOC = "doc_id long, text string"
PAGE = "page_id long, url string, html string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def extra(df, *names):
    for name in (*names, "row", "kind", "n", "pos", "mark", "path", "host", "tokens"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, tables, name):
    line = compare(spark, duck(tables), name, tables)
    assert not line.startswith("FAIL"), line


# -- decontamination


def contamination_slow(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: word.findall((t or "").translate(lower))
    out = []
    for i, t in docs:
        words, hit, found = cut(t), set(), set()
        for item, text in items:
            w = cut(text)
            n = min(10, len(w))
            for k in range(len(w) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[k : k + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        out.append((i, len(words), len(hit), len(found), ",".join(sorted(found))))
    return collections.Counter(out)


def test_contamination_edge_cases(spark):
    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice("aa bb cc dd".split()) for _ in range(n))
    items = [(1, some(12)), (2, "Aa-BB"), (3, "cc"), (4, None), (5, "!?"), (10, some(30)), (10, "aa bb cc dd aa bb"), (2, "aa bb")]
    items.append((11, "dd dd dd dd dd dd dd"))
    docs = [(i, some(n)) for i, n in enumerate([0, 1, 5, 9, 10, 60, 200])]
    docs += [(20, None), (21, ""), (None, items[0][1] + " x " + items[0][1]), (22, "é " + items[5][1]), (3, "cc cc"), (3, "zz"), (3, "cc cc")]
    frame = extra(spark.createDataFrame(docs, DOC), "window", "step")
    bench = extra(spark.createDataFrame(items, "item_id long, text string"), "win")
    got = decontaminate.contamination(frame, bench).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"]) for r in got) == contamination_slow(docs, items)
    left = decontaminate.drop_contaminated(frame, bench)
    assert left.columns == frame.columns and sorted(r.text or "" for r in left.collect()) == sorted(
        t or "" for i, t in docs if not any(x[2] for x in contamination_slow([(i, t)], items)))
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(frame, bench.limit(0)).collect()} == {0}


# -- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def spans_slow(text):
    def good(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
        return kind != "phone" or 10 <= len(digits) <= 15

    found = [
        (m.start(), n, f"{k}:{m.start()}:{m.end()}")
        for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good(k, m.group())
    ]
    return ",".join(x[2] for x in sorted(found))


def test_personal_data_matches_brute_force(spark, tables):
    rng = random.Random(7)
    pieces = ["a@b.c", "x_", "@", ".", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "000255.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (017) 555-7713",
              "+", "é", " ", "\n", "-", "%", "12", "9" * 18, "+49 30 123456", "a@b..c", "DE89 3704 0044 0532 0130 00", "😀"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    texts += ["1" * 60_000, "a" * 60_000 + "@b" + ".c" * 20_000, "1 " * 40_000, "", None, "a@b.c_x@d.e", "+1" + "-" * 30_000 + "2"]
    texts += [r.text for r in spark.read.parquet(f"{tables}/documents.parquet").select("text").collect()]
    frame = extra(spark.createDataFrame(list(enumerate(texts)), DOC), "start", "end", "score", "idx", "value")
    got = {r.doc_id: r for r in pii.summarise(frame).collect()}
    for i, t in enumerate(texts):
        assert got[i].base == spans_slow(t), t
        assert got[i].n_email == got[i].base.count("email:")
    assert pii.summarise(frame.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c")], DOC)
    assert [r.n_email for r in pii.summarise(twice).collect()] == [1, 1, 1]


def test_further_kinds_need_checksum_or_context(spark):
    texts = ["pay to IBAN DE89 3704 0044 0532 0130 00 now", "DE88 3704 0044 0532 0130 00", "SSN 123-45-6789", "part 123-45-6789", "GB82WEST12345698765432"]
    got = collections.defaultdict(list)
    for r in pii.find_spans(spark.createDataFrame(list(enumerate(texts)), DOC)).collect():
        got[r.doc_id].append((r.kind, r.value, round(r.score, 2)))
    assert got[0] == [("iban", "DE89 3704 0044 0532 0130 00", 1.0)] and got[1] == []
    assert got[2] == [("ssn", "123-45-6789", 0.6)] and got[3] == [] and got[4] == [("iban", "GB82WEST12345698765432", 0.8)]


def test_context_on_both_sides_and_across_matches(spark):
    gap = "word " * 17
    texts = [
        "123-45-6789 is my SSN", "SSN: 111-22-3333, 222-33-4444, 333-44-5555", f"SSN {gap}123-45-6789", "x" * 500 + " SSN " + "y " * 60 + "123-45-6789",
        "123-45-6789" + " z" * 60 + " SSN", "lesson 123-45-6789", "123-45-6789 SSNs", "Ssn:123-45-6789", "é" * 99 + "ssn 123-45-6789",
        "111-22-3333 " * 20 + "ssn",
    ]
    got = collections.Counter()
    for r in pii.find_spans(spark.createDataFrame(list(enumerate(texts)), DOC)).collect():
        got[r.doc_id] += r.kind == "ssn"
    assert [got[i] for i in range(9)] == [1, 3, 1, 0, 0, 0, 0, 1, 0]
    assert got[9] == 9  # those whose next 100 code points hold the word as a whole

    # against a reading of the texts themselves
    rng = random.Random(5)
    bits = ["ssn", " ", "123-45-6789", ", ", "é", "word " * 9, "id", "."]
    texts = ["".join(rng.choice(bits) for _ in range(40)) for _ in range(60)]
    cue = re.compile(r"(?<![^\W\d_])(?:ssn|social|security|national|id)(?![^\W\d_])", re.I)
    want = collections.Counter()
    for i, text in enumerate(texts):
        for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
            want[i] += any(cue.search(side) for side in (text[max(0, m.start() - pii.NEAR) : m.start()], text[m.end() : m.end() + pii.NEAR]))
    got = collections.Counter(r.doc_id for r in pii.find_spans(spark.createDataFrame(list(enumerate(texts)), DOC)).collect() if r.kind == "ssn")
    assert got == +want


# -- chat


def check_chat(spark, rows, budget, history):
    frame = extra(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "window", "at", "system", "half")
    windows = chat.format_windows(frame, budget, history).collect()
    got = {r.conv_id: r for r in chat.digests(chat.format_windows(frame, budget, history)).collect()}
    talks = collections.defaultdict(list)
    for c, t, role, text in rows:
        talks[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    return windows


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["~", "~0", "~1", "<", "[INST]", "</s>", "<|end|>", "<|turn|>", "<|text|>", "wort", " ", "\n", "\\", "é", "😀", "x y z"]
    rows = []
    for c in range(25):
        for t in range(rng.randrange(1, 30)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "<|end|>", None])
            rows.append((c, t, role, "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 40])))))
    rows += [(None, None, "user", None), (None, 1, "assistant", "a"), (99, 1, "user", "b"), (99, 1, "user", "b"), (98, 0, "system", "only")]
    rows += [(97, t, "assistant", "w " * 5000) for t in range(3)]
    for budget, history in ((60, 15), (1024, 256), (8, 0)):
        windows = check_chat(spark, rows, budget, history)
        for w in windows:
            parts = w.formatted.split(chat.END)[:-1]
            costs = [len(re.findall(r"[^\W_]+|[^\w\s]|_", re.sub("~0|~1|~2", "~", p.split(chat.BODY)[1]))) for p in parts]
            system = parts[0].startswith(chat.START + "system" + chat.BODY)
            held = costs[0] if system else 0
            # the system turn and the history always fit in; what is left goes to fresh turns, or to one that is too long
            assert sum(costs) <= max(budget, held + history + 2) or len(parts) - max(w.n_repeated, system) <= 1


def test_chat_repeats_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", f"word{t} and more") for t in range(1, 20)]
    windows = sorted(check_chat(spark, rows, 30, 7), key=lambda w: w.window)
    assert len(windows) > 2 and all(w.formatted.startswith(chat.START + "system" + chat.BODY + "be kind") for w in windows)
    assert [w.n_repeated for w in windows][0] == 0 and all(w.n_repeated == 3 for w in windows[1:])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_windows(empty)).count() == 0


# -- archives


def test_archives_edge_cases(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "http://a/b c\r\nX: y", big), (2, None, big), (None, "u", big), (7, "u", "small"), (8, "u", "small"), (9, "é", None), (1, "u", "😀" * 60_000)]
    frame = extra(spark.createDataFrame(rows, PAGE), "digest", "first", "again_id")
    got = {r.page_id: r for r in warc.archive_pages(frame).collect()}
    assert len(got) == 7 and all(r.error is None for r in got.values())
    for i, _, h in rows:
        raw = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 2, None: 2}
    assert warc.archive_pages(frame.limit(0)).count() == 0
    same = spark.createDataFrame([(3, "u", big), (3, "u", big), (4, "u", big)], PAGE)
    kinds = sorted((r.page_id, r.record_type) for r in warc.archive_pages(same).collect())
    assert kinds == [(3, "response"), (3, "response"), (4, "revisit")]


def test_reader_validates():
    record = warc._record(1, "http://a", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    words = zstandard.ZstdCompressionDict(b"WARC-Type response Content-Length HTTP/1.1 200 OK " * 20)
    press = zstandard.ZstdCompressor(dict_data=words)
    lead = struct.pack("<II", warc.DICTIONARY_FRAME, len(words.as_bytes())) + words.as_bytes()
    good = press.compress(record)
    assert [r["error"] for r in warc.read_archive(lead + good + good)] == [None, None]
    packed = zstandard.ZstdCompressor().compress(words.as_bytes())
    assert [r["page_id"] for r in warc.read_archive(struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed + good)] == [1]
    for bad in (record[:-1], record.replace(b"hello", b"hallo"), record.replace(b"WARC/1.1", b"WARC/0.9"), record.replace(b"WARC-Date", b"X-Date")):
        out = [r["error"] for r in warc.read_archive(lead + press.compress(bad) + good)]
        assert out[0] and out[1] is None
    assert [r["error"] for r in warc.read_archive(lead + good + good[:-3])] == [None, "cut frame"]
    assert list(warc.read_archive(b"")) == [] and next(warc.read_archive(b"no archive"))["error"] == "no frame"


def test_archives_roll_over(spark, tmp_path):
    pages = [(i, f"http://h/{i}", random.Random(i).randbytes(3000).hex()) for i in range(300)]
    frame = spark.createDataFrame(pages + [(300, "u", pages[0][2])], PAGE).coalesce(2)
    folder = str(tmp_path / "archives")
    written = warc.write_archives(frame, folder, roll=100_000).collect()
    files = sorted((tmp_path / "archives").iterdir())
    assert sorted(r.path for r in written) == [str(f) for f in files] and sum(r.n for r in written) == 301
    assert len(files) > 6 and all(f.stat().st_size < 110_000 + warc.DICTIONARY_BYTES for f in files)
    got = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert len(got) == 301 and all(r.error is None for r in got.values())
    assert got[300].refers_to == 0 and {got[i].payload_digest for i in range(300)} == {sha(p[2]) for p in pages}
    # what a lost attempt left behind is not read, and a stream may come in pieces
    (tmp_path / "archives" / "_draft-000000-0000-x").write_bytes(files[0].read_bytes())
    assert warc.read_archives(spark, folder).count() == 301

    class Slow(io.BytesIO):
        def read(self, size=-1):
            return super().read(min(size, 7))

    raw = files[0].read_bytes()
    assert list(warc.read_archive(Slow(raw))) == list(warc.read_archive(raw))


# -- pages


def test_text_of_known_pages(spark, tables):
    rows = spark.read.parquet(f"{tables}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_text.extract_text(spark.read.parquet(f"{tables}/pages.parquet")).collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|<footer|$)", r.html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", " ", b))).strip() for b in re.split("</?p>|</?h1>", body)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_parsing():
    text = lambda page: html_text.page_text(page, set())
    assert text("<article><p>a <b>b</b>\n c&amp;d &eacute;&#33;<p>e<br>f<ul><li>g<li>h</ul></article>") == "a b c&d é!\n\ne f\n\ng\n\nh"
    assert text("<article><p>a</p><div class='comments'><p>b</div><aside>c</aside><form>d</form><script>e</script></article><p>f") == "a"
    assert text("<body><div id=sidebar>a</div><div role=navigation>b</div><div>c</div><div class='cookie-notice'>d</div>") == "c"
    assert text("<article><header><h1>t</h1></header><p>x") == "t\n\nx" and text("<header>t</header><p>x") == "x"
    assert text("") == "" and text("plain <b>text") == "plain text" and text("a < b <") == "a < b <"
    assert text("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert text("<article><p>a<!-- <p>no --><p>b<style>p{}</style") == "a\n\nb"
    assert text("<main><table><tr><td>a<td>b<tr><td>c</table></main>") == "a\n\nb\n\nc"


def test_style_tree_cuts_what_repeats(spark):
    page = lambda i: f"<body><div class='x1'>All rights belong to us</div><div class='x2'><p>story {i} tells</p><p>more {i * 7}</p></div>"
    rows = [(i, "http://h.org/1", page(i)) for i in range(20)] + [(50, None, page(1)), (51, "http://k.org/", None), (51, "http://k.org/", "")]
    frame = extra(spark.createDataFrame(rows, PAGE), "low", "text", "look")
    got = collections.Counter((r.page_id, r.text) for r in html_text.extract_text(frame).collect())
    want = collections.Counter((i, f"story {i} tells\n\nmore {i * 7}") for i in range(20))
    want.update([(50, "story 1 tells\n\nmore 7"), (51, ""), (51, "")])
    assert got == want and html_text.extract_text(frame.limit(0)).count() == 0


def test_copies_of_a_page_keep_its_text(spark):
    story = lambda k: f"<body><div class='a'><p>story {k} tells</p></div><main><p>part {k}</p></main>"
    plain = lambda k: f"<body><div class='a'><p>story {k} tells</p></div><p>rest"
    rows = [(i, "http://eight.org/", plain(0)) for i in range(8)] + [(i, "http://many.org/", plain(i % 3)) for i in range(1000)]
    rows += [(i, None, story(i % 2)) for i in range(1000)]
    got = collections.Counter((r.url, r.text) for r in html_text.extract_text(spark.createDataFrame(rows, PAGE)).collect())
    assert got == collections.Counter((u, f"part {i % 2}" if u is None else re.sub("<[^>]*>", "", h).replace("rest", "\n\nrest")) for i, u, h in rows)
    page = plain(0)
    every = {path for path, *_ in html_text.tree_rows(page)}
    assert html_text.page_text(page, every) == html_text.page_text(page, set()) != ""


def test_style_tree_decides_on_article_pages(spark):
    page = lambda i: (
        f"<body><div class='x1'>Lead <b>{i}</b><p>of story {i * 3}</p></div><div class='x2'>All rights belong to us</div>"
        f"<article><h1>Title {i}</h1><p>story {i} <i>again</i></p><div class='x3'><p>Read us <i>daily</i></p></div></article>"
    )
    alike = "<body><article><p>one text</p></article><div class='x4'>{}</div>"
    rows = [(i, "http://h.org/", page(i)) for i in range(20)] + [(50, "http://few.org/", page(1))]
    rows += [(100 + i, "http://same.org/", alike.format(i)) for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, PAGE)).collect()}
    for i in range(20):
        assert got[i] == f"Lead {i}\n\nof story {i * 3}\n\nTitle {i}\n\nstory {i} again"
        assert got[100 + i] == f"one text\n\n{i}"
    assert html_text.page_text(page(1), set()) == "Title 1\n\nstory 1 again\n\nRead us daily"
    assert got[50] == "Title 1\n\nstory 1 again"  # a single page borrows what the other host shows


def test_telling_classes_never_drop_a_story(spark):
    names = ["social-history", "side-effects", "related-work", "menu-of-the-day", "notice", "alert", "share", "reply"]
    inner = "".join(f"<div class='{n}'><p>{n} {{0}} says</p></div>" for n in names)
    page = lambda i: (
        "<div class='side-content'><article><h1>Title {0}</h1><h2 id='related'>Heading {0}</h2>" + inner
        + "<div class='newsletter'><p>Get our letter</p></div><div class='ad'>Buy {0}</div><div class='comments'><p>I said {0}</p></div>"
        + "<p>x <math>a<mo>+</mo>{0}</math> y</p></article></div><div class='notice'>outside {0}</div>"
    ).format(i)
    story = lambda i: "\n\n".join([f"Title {i}", f"Heading {i}", *(f"{n} {i} says" for n in names)])
    for copies in (1, 2, 9, 40):
        rows = [(i, "http://h.org/", page(i)) for i in range(copies)]
        got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, PAGE)).collect()}
        kept = "" if copies > 2 else "\n\nGet our letter"  # nothing confirms the guess on so few pages
        assert got == {i: f"{story(i)}{kept}\n\nx a+{i} y" for i in range(copies)}, copies
    # without an article a guess holds until the pages refute it
    text = "<div class='menu'>Dish {0} of the day</div><div class='toolbar'>save as</div><p>end {0}</p>".format
    rows = [(i, "http://m.org/", text(i)) for i in range(100)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {i: f"Dish {i} of the day\n\nend {i}" for i in range(100)}
    assert html_text.page_text(text(1), ()) == "end 1"


def test_style_tree_decides_on_given_pages(spark, tables):
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    bare = {r.page_id: html_text.page_text(r.html, ()) for r in queries.relabelled(pages).collect()}
    want = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    got = {r.page_id: r.text for r in queries.QUERIES["style_tree_text"](spark, tables).collect()}
    assert got == want and all(bare[i].endswith(t) and "is read daily." in bare[i] for i, t in want.items())


def test_style_tree_equals_plain_tree(spark, tables):
    pages = queries.relabelled(spark.read.parquet(f"{tables}/pages.parquet"))
    rows = [(r.url, r.html) for r in pages.collect()] + [(None, None), (None, "<p>a"), ("http://h/", "<p>a")] + [("x://h/y", f"<p>{i % 3}") for i in range(9)]
    hosts = collections.defaultdict(set)
    for url, page in rows:
        host = re.search("://([^/?#]*)", url or "")
        hosts[host.group(1).lower() if host else ""].add(tuple(html_text.tree_rows(page or "")))
    entropy = lambda seen: -sum(n / len(seen) * math.log(n / len(seen), len(seen)) for n in collections.Counter(seen).values()) if len(seen) > 1 else 1.0
    own, marks = {}, collections.Counter()
    for host, trees in hosts.items():
        at = collections.defaultdict(list)
        for tree in trees:
            for path, look, words, mark in tree:
                at[path].append((look, words))
                marks[host, path] |= mark
        for path, seen in at.items():
            own[host, path] = len(seen), 0.1 * entropy([x for x, _ in seen]) + 0.9 * entropy([x for _, x in seen])
    weight, total = collections.Counter(), collections.Counter()
    for (_, path), (n, value) in own.items():
        weight[path] += n - 1
        total[path] += (n - 1) * value

    def drawn(host, path, prior):
        n, value = own[host, path]
        return ((n - 1) * value + 4 * (total[path] + 4 * prior) / (weight[path] + 4)) / (n + 3)

    want = set()
    for host, path in own:
        mark = marks[host, path]
        low = drawn(host, path, 1) < 0.5 and mark & 4 if mark & 2 else drawn(host, path, 1) < 0.3
        high = (not mark & 4 if mark & 2 else mark & 1) and drawn(host, path, 0) >= 0.8
        if weight[path] and (low or high):
            want.add((host, path, bool(low), bool(high)))
    frame = spark.createDataFrame(rows, "url string, html string")
    assert {tuple(r) for r in html_text.judged_paths(html_text.style_tree(frame)).collect()} == want and want


def test_long_page_and_many_classes(spark):
    long = "<article>" + "".join(f"<p class='c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}'>word {i}" for i in range(60_000)) + "</article>"
    many = lambda k: "<article>" + "".join(f"<p class='k{chr(97 + k)}-{chr(97 + i % 26)}{chr(97 + i // 26)}'>{k} {i}" for i in range(600))
    rows = [(99, "http://h.org/", long)] + [(k, "http://h.org/", many(k)) for k in range(20)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got.pop(99) == "\n\n".join(f"word {i}" for i in range(60_000))
    assert got == {k: "\n\n".join(f"{k} {i}" for i in range(600)) for k in range(20)}


# -- urls


def test_url_rules(spark):
    urls = ["http://a.example.NET/en/1?x", "http://example.net/fr", "http://b.example.com/de/1", "http://c.org/fr/x#y", "http://notnet/x", "x.net/",
            None, "http://net", "http://a.net?x=/", "https://x.org/de", "a://b://c.net/d"]
    frame = extra(spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGE), "rule", "url_", "doc_id")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_rules.filter_urls(frame, queries.URL_RULES).orderBy("page_id").collect()]
    assert got == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/fr", "net/", "block"), ("b.example.com", "/de/1", "example.com/de/", "block"),
        ("c.org", "/fr/x", "org/fr/", "allow"), ("notnet", "/x", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "", None, "allow"),
        ("a.net", "", None, "allow"), ("x.org", "/de", None, "allow"), ("b:", "//c.net/d", None, "allow"),
    ]


def test_mined_rules(spark):
    rows = [(i, f"http://{'spam' if i % 4 == 0 else 'good'}.com/{'win' if i % 3 == 0 else 'news'}/{i}") for i in range(400)]
    labels = [(i, 0 if i % 12 == 0 else 1, 0) for i in range(0, 400, 2)] + [(None, 0, 0), (3, None, 0), (24, 0, 0)]
    frame = spark.createDataFrame([(i, u, "") for i, u in [*rows, *rows[:12]]], PAGE)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = url_rules.filter_urls(frame, [], table).collect()
    assert len(got) == 412 and all((r.verdict == "block") == ("spam" in r.host and "win" in r.path) for r in got)
    assert {r.verdict for r in url_rules.filter_urls(frame, [], table.limit(0)).collect()} == {"allow"}
    assert url_rules.filter_urls(frame.limit(0), [], table).count() == 0


# -- quality


def test_mined_rules_of_any_length_and_table_size(spark):
    four = ["h0=a", "h1=b", "h2=c", "p0=d"]
    rows = [(four, True)] * 20 + [([t for t in four if t != left], False) for left in four for _ in range(30)]
    many = spark.range(100_000).selectExpr("array(concat('p0=', id % 5), 'h0=com') AS tokens", "false AS bad")
    spam = spark.range(50).selectExpr("array('h0=com', 'h1=spam') AS tokens", "true AS bad")
    frame = spark.createDataFrame(rows, "tokens array<string>, bad boolean").union(many).union(spam)
    got = sorted(sorted(r.tokens) for r in url_rules.mine_rules(frame).collect())
    assert got == [four, ["h1=spam"]]


def blocked_by_all_subsets(labelled, asked, least=10, confidence=0.6):
    """Every token set of the bad rows, counted over all rows; a row is blocked if it holds a certain one."""
    counts = collections.Counter()
    for tokens, bad in labelled:
        if bad:
            some = sorted(set(tokens))
            counts.update(c for n in range(1, len(some) + 1) for c in itertools.combinations(some, n))
    certain = []
    for c, n in counts.items():
        if n >= least and n / sum(set(c) <= set(tokens) for tokens, _ in labelled) >= confidence:
            certain.append(set(c))
    return [any(c <= set(tokens) for c in certain) for tokens in asked]


@pytest.mark.parametrize("seed", range(4))
def test_mined_verdicts_equal_all_subsets(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(8)]
    labelled = []
    for _ in range(240):
        tokens = [w for w in words if rng.random() < 0.45] + ["com"]
        if "w1" in tokens:
            tokens.append("w1twin")  # always together
        bad = {"w1", "w2", "w3"} <= set(tokens) or (rng.random() < 0.25 + 0.35 * ("w5" in tokens))
        labelled.append((tokens, bad))
    asked = [[w for w in [*words, "w1twin", "com", "other"] if rng.random() < 0.5] for _ in range(200)]
    rules, items = url_rules._mined(spark.createDataFrame(labelled, "tokens array<string>, bad boolean"), 10, 0.6)
    rows = spark.createDataFrame(list(enumerate(asked)), "row long, tokens array<string>")
    hit = {r.row for r in url_rules.match_rules(url_rules._with_items(rows, items), rules).collect()}
    assert [i in hit for i in range(200)] == blocked_by_all_subsets(labelled, asked)
    sets = [set(r.tokens) for r in rules.collect()]
    assert not any(a < b for a in sets for b in sets)  # no rule that a shorter one implies


def test_deep_paths_are_mined_in_seconds(spark):
    deep = "/".join(f"part{chr(97 + i)}" for i in range(25))
    rows = [(i, f"http://bad.example/{deep}/{i}") for i in range(20)] + [(20 + i, f"http://good.example/news/{i + 20}") for i in range(60)]
    rows += [(90 + i, f"http://both.example/{deep}x/{i % 2}/{90 + i}") for i in range(80)]
    labels = [(i, int(i >= 20 and not 90 <= i < 120), 0) for i in range(170)]
    frame = spark.createDataFrame([(i, u, "") for i, u in rows], PAGE)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    start = time.monotonic()
    got = {r.page_id: r.verdict for r in url_rules.filter_urls(frame, [], table).collect()}
    assert time.monotonic() - start < 60
    assert all(got[i] == "block" for i in range(20)) and all(got[i] == "allow" for i in range(20, 80))
    assert url_rules.filter_urls(frame, [], table.limit(0)).where("verdict = 'block'").count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op6_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_quality_edge_cases(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice("the of and river mountain walks slowly".split()) for _ in range(60))
    rows = [(i, good() if i % 2 else good().upper().replace(" ", "!! ")) for i in range(200)]
    odd = [(300, None), (301, ""), (None, "x"), (302, "é" * 300_000), (303, "a\n" * 100_000), (0, "repeated id")]
    frame = extra(spark.createDataFrame(rows + odd, DOC), "score", "y", "x")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(frame, labels)
    got = quality.score(frame, model).collect()
    assert len(got) == 206 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and 0 < r.doc_id < 200)
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns and {i for i in range(1, 200, 2)} <= {r.doc_id for r in kept.collect()}
    assert quality.train(frame, labels.limit(0)) is None and quality.keep_good(frame, labels.limit(0)).count() == 206
    assert quality.score(frame.limit(0), model).count() == 0


def test_passages_do_not_depend_on_batches():
    import numpy as np
    import pyarrow as pa

    texts = ["Some words here " * 100, "", "X!! Y!! " * 300, "é"]
    whole = [quality.encode(d, b)[0] for _, _, d, b in quality._chunks(pa.array(texts))]
    alone = [quality.encode(d, b)[0] for t in texts for _, _, d, b in quality._chunks(pa.array([t]))]
    assert np.allclose(np.concatenate(whole), np.concatenate(alone), atol=0.02)


# -- pipeline


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "copy", "shuffle_key"]
    kept = out.select("doc_id", "text").distinct().collect()
    assert 500 < len(kept) < 1000
    assert len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in kept}) == len(kept)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    slow = contamination_slow([(r.doc_id, r.text) for r in kept[:40]], items)
    assert all(n_hit == 0 for _, _, n_hit, _, _ in slow)
