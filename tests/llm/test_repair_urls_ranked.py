"""Conversation repair, URL filters and ranked search against plain versions, in small blocks, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import subprocess
import sys
import textwrap
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from legflow.llm import queries, ranked, repair, urls
from legflow.llm.shared import table
from tests.conftest import SF_SMALL
from tests.llm import brute

# ------------------------------------------------------------------- conversation repair

TURN = "conv_id bigint, turn int, role string, text string"
INITIALS = re.compile("(s?(ua)+)?")


def faults(lines):
    """b, d, t or - of each (role, text)."""
    seen, out = set(), []
    for role, text in lines:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def every_repair(lines, most=2):
    """Least (cost, audit, repaired) over all edit sequences with at most ``most`` insertions in each gap."""
    kinds = faults(lines)
    options = []
    for (role, text), kind in zip(lines, kinds):
        here = [(3, "D", None)]
        if kind in "-t":
            extra = kind == "t"
            here += [(extra, "K", (role, text))] + [(2 + extra, "R", (r, text)) for r in ("user", "assistant")]
        options.append(here)
    inserted = [[(2, "I", (r, "")) for r in rs] for n in range(most + 1) for rs in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for edits in itertools.product(*options):
        for gaps in itertools.product(inserted, repeat=len(lines) + 1):
            seq = [*gaps[0], *(x for e, g in zip(edits, gaps[1:]) for x in [e, *g])]
            kept = [x[2] for x in seq if x[2]]
            if any(not r for r, _ in kept) or not INITIALS.fullmatch("".join(r[0] for r, _ in kept)):
                continue
            got = (sum(x[0] for x in seq), "".join(x[1] for x in seq), [f"{r}:{t}" for r, t in kept])
            if best is None or got[:2] < best[:2]:
                best = got
    return best


def least_repair(lines):
    """The same by plain dynamic programming over prefixes, for longer conversations."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    state = {"": (0, "", [])}

    def grown(state):
        for _ in range(2):
            for q, (c, a, o) in list(state.items()):
                for x, name in (("u", "user"), ("a", "assistant")):
                    to = steps.get((q, x))
                    if to and (to not in state or (c + 2, a + "I") < state[to][:2]):
                        state[to] = (c + 2, a + "I", [*o, f"{name}:"])
        return state

    for (role, text), kind in zip(lines, faults(lines)):
        after = {}
        for q, (c, a, o) in grown(state).items():
            ways = [(c + 3, a + "D", o, q)]
            if kind in "-t":
                extra = kind == "t"
                ways += [(c + extra, a + "K", [*o, f"{role}:{text}"], steps.get((q, role[:1])))]
                ways += [(c + 2 + extra, a + "R", [*o, f"{r}:{text}"], steps.get((q, r[0]))) for r in ("user", "assistant")]
            for cost, audit, out, to in ways:
                if to is not None and (to not in after or (cost, audit) < after[to][:2]):
                    after[to] = (cost, audit, out)
        state = after
    return min(grown(state)[q] for q in ("", "a") if q in grown(state))


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_lines(rng, n):
    texts = ["Yes.", "No", "", " \t", "Why?", "So", "Äh!", "Well. \n"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "usher"]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_solved_blocks_are_the_least_of_all_edit_sequences():
    rng = random.Random(3)
    for _ in range(60):
        lines = random_lines(rng, rng.randint(0, 3))
        codes = tuple(r[:1] + k for (r, _), k in zip(lines, faults(lines)))
        want = every_repair(lines)
        assert least_repair(lines) == want
        (_, _, cost, audit), = repair.solved(codes, True)
        assert (cost, audit) == want[:2]
        goals = [x for x in repair.solved(codes, False) if x[0] == 0 and x[1] in repair.ACCEPT]
        assert min((x[2], x[3]) for x in goals) == want[:2]


def test_joined_blocks_equal_one_block():
    rng = random.Random(8)
    for _ in range(40):
        lines = random_lines(rng, rng.randint(2, 12))
        codes = tuple(r[:1] + k for (r, _), k in zip(lines, faults(lines)))
        cuts = sorted(rng.sample(range(1, len(codes)), rng.randint(1, len(codes) - 1)))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        whole = {x[:2]: x[2:] for x in repair.solved(codes, False)}
        got = {x[:2]: x[2:4] for x in repair.joined([list(repair.solved(p, False)) for p in parts])}
        assert got == whole


def plain(rows):
    """conv_id -> the result of plain dynamic programming over (conv_id, turn, role, text) rows after damage."""
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        lines = [(r[2], r[3]) for r in mine]
        kinds = faults(lines)
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, kept = least_repair(lines)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(x) for x in "bdt"),
                     sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:])), cost, audit, sha(kept))
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        sp = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def result(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def check_repair(spark, rows):
    got = result(repair.repaired_conversations(spark.createDataFrame(rows, TURN)))
    want = plain(damaged(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", sha([]))
    assert got == {c: want.get(c, nothing) for c in {r[0] for r in rows}}


def test_repair_query_is_the_plain_one(spark):
    rows = [tuple(r) for r in table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op11_lightest_repair(spark, SF_SMALL)) == plain(damaged(rows))


def odd_turns():
    gone = [c for c in range(400, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    return [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (101, None, "user", "x."), (101, None, "user", "x."), (101, 5, None, "y."),
            (101, 5, "assistant", None), (102, 0, "", "no speaker."), (103, None, None, None), (104, -3, "system", "only."), (104, 10, "user", "z" * 300_000),
            (105, 2**31 - 1, "user", "end."), (105, -2**31, "user", "start."), (106, 0, "Ärzt", "ü?"), *[(107, 1, "user", "same.")] * 50,
            *[(c, 0, "user", "x.") for c in gone]]


def test_repair_of_conversations_over_many_blocks_and_ranges_and_odd_rows(spark, monkeypatch):
    """Small blocks and fans: one conversation holds most rows, and lies in many ranges, blocks and levels."""
    monkeypatch.setattr(repair, "BLOCK", 4)
    monkeypatch.setattr(repair, "FAN", 3)
    rng = random.Random(5)
    rows = [(1, t, *x) for t, x in enumerate(random_lines(rng, 120))] + [(c, t, *x) for c in range(2, 12) for t, x in enumerate(random_lines(rng, 4))]
    rows += [(40, t, "user" if t % 2 == 0 else "assistant", f"line {t}.") for t in range(40)] + odd_turns()
    rng.shuffle(rows)
    check_repair(spark, rows)


def test_repair_with_clashing_columns_and_without_rows(spark):
    rows = odd_turns()
    extra = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURN + ", uid string, cost int, block int")
    want = plain(damaged(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", sha([]))
    assert result(repair.repaired_conversations(extra)) == {c: want.get(c, nothing) for c in {r[0] for r in rows}}
    assert repair.repaired_conversations(spark.createDataFrame([], TURN)).count() == 0


def test_repaired_turns_hold_texts_and_edits(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (2, 0, "assistant", "Hello.")]
    turns, facts = repair.repair(spark.createDataFrame(rows, TURN))
    got = [(r.conv_id, r.edit, r.role, r.text) for r in turns.orderBy("conv_id", "block", "nth").collect()]
    assert got == [(1, "K", "user", "Hi."), (1, "R", "assistant", "Still there?"), (2, "I", "user", ""), (2, "K", "assistant", "Hello.")]
    assert {r.conv_id: (r.cost, r.audit, r.illegal) for r in facts.collect()} == {1: (2, "KR", 1), 2: (2, "IK", 0)}


# ------------------------------------------------------------------- URL filters

URLS = [None, "", "nourl", "http://", "http:///de/x", "HTTP://Shop.COM/fr/1?x=/de/", "https://www.example.org/en/148.html#top", "https://example.org/es/",
        "http://notexample.org/es/1", "http://org", "http://org/", "http://a.org:80/x", "x://y.com/de/#q://z.org/", "http://a.com?/fr/", "ftp://ü.com/fr/ö",
        "http://" + "a." * 5000 + "com/de/" + "x" * 20_000, "http://.org/", "http://com./fr/", "see http://b.org/en http://c.com/fr/", "://com/fr/"]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(brute.LOWER)
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(rule), len(h), verdict == "block", rule, verdict))
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("short, most", [(urls.SHORT, urls.BROADCAST_RULES), (1, 0)])
def test_urls_are_judged_by_the_longest_rule(spark, monkeypatch, short, most):
    """Also where one hexadecimal digit leaves nearly all to the full digests, and rules are shuffled."""
    monkeypatch.setattr(urls, "SHORT", short)
    monkeypatch.setattr(urls, "BROADCAST_RULES", most)
    rules = queries.URL_RULES + [("com", "block"), ("a.com/", "allow"), ("example.org/en/148", "allow"), ("b.org/", "block"), ("b.org/", "allow"), ("/x", "block"),
                                 ("ü.com/fr/ö", "block")]
    pages = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[6]), (3, URLS[6])]
    frame = spark.createDataFrame([(*p, "h", "p", "r", "v", "s") for p in pages],
                                  "page_id bigint, url string, host string, path string, rule string, verdict string, short string")
    table_ = spark.createDataFrame([*rules, (None, "block"), ("x/", None)], "rule string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, table_).collect()), key=repr)
    assert got == sorted(((i, *judged(u, rules)) for i, u in pages), key=repr)
    kept = urls.allowed(frame, table_)
    assert kept.columns == frame.columns and kept.count() == sum(x[-1] == "allow" for x in got)


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    none = spark.createDataFrame([], "rule string, verdict string")
    assert {r.verdict for r in urls.judge(pages, none).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), none).count() == 0
    assert urls.judge(pages.limit(0), spark.createDataFrame(queries.URL_RULES, "rule string, verdict string")).count() == 0


def test_url_query_is_the_plain_one(spark):
    rows = table(spark, SF_SMALL, "pages").select("page_id", "url").collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op12_url_expressions(spark, SF_SMALL).collect()}
    assert got == {r.page_id: judged(r.url, queries.URL_RULES) for r in rows}


# ------------------------------------------------------------------- ranked search

def plain_ranking(docs, items, top=10):
    terms = lambda t: [w.translate(brute.LOWER) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, len(w), {x: w.count(x) for x in set(w)}) for i, w in bags if w]
    n_docs, n_words = len(bags), sum(n for _, n, _ in bags)
    df: dict = {}
    for _, _, bag in bags:
        for x in bag:
            df[x] = df.get(x, 0) + 1
    queries_: dict = {}
    for i, t in set(items):
        queries_.setdefault(i, []).extend(terms(t))
    out = []
    for i, words in queries_.items():
        scores = []
        for d, n, bag in bags:
            m = 25 + 75 * n * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * bag[x] // (1000 * bag[x] + 8 * m)) for x in words if x in bag)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def ranking(docs, items, **kw):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked.search(docs, items, **kw).collect()), key=repr)


def test_ranked_query_is_the_plain_one(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in queries.op13_bag_ranking(spark, SF_SMALL).collect()), key=repr)
    assert got == plain_ranking(docs, items)


def test_ranking_of_copies_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ranked, "CLASSES", 3)
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma", "naïve", "x9", "the", "THE", "über"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in rng.sample(range(-300, 300), 250)]
    docs += [(1000 - i, "alpha beta, the") for i in range(40)] + [(7, "alpha beta, the")] * 3 + [(None, "alpha beta the")] * 2
    docs += [(2000, None), (2001, ""), (2002, "  ..."), (2003, " ".join(f"w{i} alpha" for i in range(40_000)))]
    items = [(1, "Alpha the THE"), (2, "beta\nbeta gamma"), (3, None), (4, "..."), (5, "absent"), (6, "über naïve"), (6, "x9"), (6, "x9"), (None, "gamma")]
    frame = spark.createDataFrame([(i, t, 1, b"x", 2) for i, t in docs], "doc_id bigint, text string, m int, bag binary, n int")
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id bigint, text string, rank int")
    want = plain_ranking(docs, [x for x in items if x[1]])
    assert ranking(frame.repartition(5), bench) == want
    assert ranking(frame, bench, block_bytes=20) == want
    assert ranking(frame, bench, top=3) == plain_ranking(docs, [x for x in items if x[1]], 3)


def test_ranking_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    bench = spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert ranked.search(docs.limit(0), bench).count() == 0 and ranked.search(docs, bench.limit(0)).count() == 0
    assert [tuple(r) for r in ranked.search(docs, bench).collect()] == [] or ranked.search(docs, bench).columns == ["item_id", "rank", "doc_id", "score"]


def test_words_with_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    """With every hash forced to one of few values, what is found is still exactly the vocabulary's words."""
    from legflow.llm import words as W
    import pyarrow as pa

    vocabulary = ranked.Vocabulary(["one two three"])
    (_, _, data, offsets), = W.pieces(pa.array(["one TWO tow eno three thrae"]))
    w = W.split_words(data, offsets, W.plain_words())
    w.hash[[2, 3, 5]] = w.hash[[1, 0, 4]]
    where, _ = vocabulary.found(w)
    assert where.tolist() == [0, 1, 4]


# ------------------------------------------------------------------- large budgets, odd records, shared ids

def filled(children, budget):
    """Integer water-filling of (name, cap, weight) by the definition: fullest first, the rest in proportion."""
    order = sorted(children, key=lambda c: (c[1] * 10**9 // c[2], c[1], c[0]))
    left, weight, out = budget, sum(c[2] for c in order), {}
    for i, (name, cap, w) in enumerate(order):
        if left > 0 and cap * weight <= left * w:
            out[name] = cap
            left, weight = left - cap, weight - w
        else:
            return out | {n: max(left, 0) * x // weight for n, _, x in order[i:]}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_budgets_of_huge_leaves(spark, seed):
    """Leaves of 1e3 to 1e13 words and weights of 1 to 1,000, against plain big integers."""
    from legflow.llm import mixing

    rng = random.Random(seed)
    names = {level: [f"{level}{i}" for i in range(3)] for level in mixing.LEVELS}
    weights = {level: {n: rng.randint(1, 1000) for n in ns} for level, ns in names.items()}
    leaves = [(d, g, s, int(10 ** rng.uniform(3, 13))) for d in names["domain"] for g in names["lang"] for s in names["source"]]
    epochs, budget = 3, sum(x[3] for x in leaves) * rng.choice((1, 2, 5)) // 2
    cap = lambda *key: epochs * sum(x[3] for x in leaves if x[:len(key)] == key)
    want, level = {}, {(): min(budget, cap())}
    for name in mixing.LEVELS:
        level = {(*key, c): g for key, b in level.items()
                 for c, g in filled([(c, cap(*key, c), weights[name][c]) for c in names[name]], b).items()}
    want = level
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, words bigint")
    got = {(r.domain, r.lang, r.source): r.grant for r in mixing.plan(frame, F.lit(budget).cast("bigint"), epochs, weights).collect()}
    assert got == want and all(v <= epochs * x[3] for x in leaves for v in [got[x[:3]]])


def test_chat_records_of_unknown_and_malformed_layouts(spark):
    from legflow.llm import chat

    texts = ['{"prompt":"p","completion":"c","id":7}', '{"messages":[{"role":"user","content":"x","name":"n"},{"role":"assistant","content":[{"type":"text","text":"y"},"z"]}]}',
             '{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}]}', '{"prompt":3}', '{"prompt":true,"completion":null}',
             '{"prompt', "[1,2]", "3", None, "", '{"other":"o"}', '{"messages":[]}', '{"messages":{"role":"user","content":"q"}}', "{" + '"a":{' * 3000]
    rows = chat.canonical(spark.createDataFrame(list(enumerate(texts)), "conv_id bigint, record string").withColumn("turn", F.lit(0).cast("bigint")))
    got = {}
    for r in rows.orderBy("conv_id", "part").collect():
        got.setdefault(r.conv_id, []).append((r.layout, r.role, r.text, r.n_unread))
    assert got[0] == [("pair", "user", "p", 1), ("pair", "assistant", "c", 1)]
    assert [x[1:3] for x in got[1]] == [("user", "x"), ("assistant", "yz")] and got[2] == [("message parts", "user", "ab", 1)]
    assert got[3] == [("prompt", "user", "3", 0)] and got[4] == [("pair", "user", "true", 0), ("pair", "assistant", "", 0)]
    assert all(len(got[i]) == 1 and got[i][0][:3] == (None, None, None) for i in range(5, 14)) and len(got) == 14
    counts = {r.layout: (r.n_records, r.n_turns) for r in chat.accounted(rows).collect()}
    assert counts == {"pair": (2, 4), "messages": (1, 2), "message parts": (1, 1), "prompt": (1, 1), None: (9, 0)}
    assert chat.digests(chat.formatted(rows)).count() == 5


def test_samples_are_bounded_by_rows(spark):
    from legflow.llm.labelled import one_row

    rows = spark.createDataFrame([(1, f"t{i % 7}", 1) for i in range(500)] + [(2, None, 0), (2, "x", 0)], "doc_id bigint, text string, y int")
    got = one_row(rows, ["doc_id", "y"])
    assert got.count() == 2 and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, one_row(rows.repartition(5), ["doc_id", "y"]).collect()), key=repr)


# ------------------------------------------------------------------- executors without the package

def test_operators_run_where_executors_lack_the_package(tmp_path):
    """A session started outside the repository: only the driver can import the package."""
    repo = Path(__file__).resolve().parents[2]
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(repo)!r})
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
                 .config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate())
        spark.sparkContext.setLogLevel("OFF")
        missing = spark.range(1).rdd.map(lambda _: __import__("importlib.util").util.find_spec("legflow") is None).collect()
        assert missing == [True]
        from legflow.llm import queries
        failed = []
        for name, query in queries.QUERIES.items():
            if name != "pipeline":
                try:
                    query(spark, {SF_SMALL!r}).count()
                except Exception as e:
                    failed.append((name, str(e)[-300:]))
        assert not failed, failed
        print("all ran")
    """)
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert "all ran" in ran.stdout, ran.stderr[-3000:]
