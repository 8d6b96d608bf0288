"""The text operators against brute force, exact round trips and held-out accuracy on small fixtures."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import conversations, neardup, overlap, packing, pii, reading, sampling, tokenizer, wordsets

RAW = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string, ingested_at timestamp"
NOW = dt.datetime(2020, 1, 1)

# -- tokenizer ---------------------------------------------------------------------------------------------------

ODD = ["", " ", "a" * 3000, " " * 500, "\x00\x01 ▁", "😀" * 50, "'s'S  \n\n \t x", "x²³ ١٢٣", "<|endoftext|>", "Grüße, e.g. 3.5%", "ab" * 900 + " " + "zq" * 900]


def test_tokens_equal_those_of_another_library():
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=tokenizer.read_ranks(), special_tokens={})
    e = tokenizer.Encoder()
    rnd = random.Random(3)
    texts = ODD + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x2FF), 0x20, 0x4E00])) for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert e.encode(t) == own.encode_ordinary(t)
        assert e.decode(e.encode(t)) == t


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, "", 6), (3, None, 7), (1, "hello world", 5)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in tokenizer.encode_corpus(df).collect())
    assert got[0] == got[1] and got[2:] == [(2, []), (3, [])]
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0


# -- packing -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_pack_keeps_within_capacity(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(0, 101, rng.integers(1, 300)))[::-1]
    windows = packing.pack(sizes, 100)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sizes[w].sum() <= 100 for w in windows)
    assert len(windows) <= 1.12 * max(1, sizes.sum() / 100) + 2


def test_pack_containers(spark):
    sizes = spark.createDataFrame([(1, 11, 250), (2, 12, 60), (3, 13, 40), (4, None, 0), (2, 12, 60)], "doc_id bigint, same bigint, n_tokens bigint")
    caps = spark.createDataFrame([(1, 100), (2, 1000), (3, None)], "capacity_id int, capacity_tokens int")
    rows = packing.pack_containers(sizes, caps).collect()
    for cap, room in ((1, 100), (2, 1000)):
        own = [r for r in rows if r.capacity_id == cap]
        load = {}
        for r in own:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        assert max(load.values()) <= room and sum(load.values()) == 350
        pieces = sorted((r.piece_no, r.first_token, r.n_tokens) for r in own if r.doc_id == 1)
        assert pieces == ([(0, 0, 100), (1, 100, 100), (2, 200, 50)] if room == 100 else [(0, 0, 250)])
        assert {r.doc_id for r in own} == {1, 2, 3, 4} and sum(r.doc_id == 2 for r in own) == 1
    assert packing.pack_containers(sizes.limit(0), caps).count() == 0


# -- conversations -----------------------------------------------------------------------------------------------


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(120)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(150)] + [(900, 900), (None, 3)]
    label, changed = {}, True
    real = [(a, b) for a, b in edges if a is not None and a != b]
    for a, b in real:
        label.setdefault(a, a)
        label.setdefault(b, b)
    while changed:
        changed = False
        for a, b in real:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = conversations.components(df).collect()
    assert {r.node: r.component for r in got} == label and len(got) == len(label)
    assert conversations.components(df.limit(0)).count() == 0


def test_part_numbers(spark):
    cases = {"1/3 a": 1, "(2 of 3) a": 2, "a [3/4]": 3, "2/4/AP b": 2, "1/2^LD c": 1, "works 1/2 of the time": None, "14/11/2017": None, "5/2 x": None, None: None, "@x 1/2 a": 1, "a 2/2": 2}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(conversations.part_number(df.t)).collect()] == list(cases.values())


def when(s):
    return f"Tue Oct 31 22:10:{s:02d} +0000 2017"


def test_rebuild(spark):
    rows = [
        ("1", "77", "True", when(0), "help", None, None),
        ("1", "77", "True", when(0), "help ", None, None),
        ("2", "Acme", None, when(5), "b 2/2", None, "1.0"),
        ("3", "Acme", "FALSE", when(5), "a 1/2", None, " 1"),
        ("4", "77", "True", when(7), "  ", None, "3"),
        ("10", "77", "True", when(0), "no answer", None, None),
        ("20", "Acme", "False", when(0), "brand first", None, None),
        ("21", "77", "True", when(1), "x", None, "20"),
        ("30", "77", "True", when(0), "bad time below", None, None),
        ("31", "Acme", "False", "n/a", "x", None, "30"),
        ("40", "77", "True", when(0), "lost", None, "99"),
        ("41", "Acme", "False", when(1), "x", None, "40"),
        ("50", "77", "True", when(0), "loop", None, "51"),
        ("51", "Acme", "False", when(0), "loop", None, "50"),
        (None, "77", "True", when(0), "x", None, "1"),
    ]
    df = spark.createDataFrame([(*r, NOW, 1) for r in rows], RAW + ", component int")
    got = sorted(tuple(r) for r in conversations.rebuild(df).select("conversation_id", "turn_no", "tweet_id", "speaker").collect())
    assert got == [(1, 0, 1, "customer"), (1, 1, 3, "brand"), (1, 2, 2, "brand")]
    counts = {r.outcome: r.conversations for r in conversations.outcome_counts(df).collect()}
    assert counts == {"kept": 1, "unanswered": 1, "not_opened_by_customer": 1, "unreadable_time": 1, "broken_link": 2}
    split = sorted(tuple(r) for r in conversations.rebuild(df, 1).select("conversation_id", "turn_no", "tweet_id", "speaker").collect())
    assert split == got  # numbered per instant
    assert conversations.rebuild(df.limit(0)).count() == 0


# -- sample ------------------------------------------------------------------------------------------------------


def test_sample_only_grows(spark):
    rnd = random.Random(1)
    rows = [
        (f"m_{i}", rnd.choice([None, f" {i % 300}", f"{i % 300}.0", str(i % 300)]), rnd.choice([None, "random", " Random", "policy-trap"]), dt.datetime(2020, 1, 1 + i // 100)) for i in range(1500)
    ]
    kind = "message_id string, conversation_id string, stratum string, logged_at timestamp"
    for rates in (None, {"random": 0.3}):
        early, late = (
            {(r.message_id, r.conversation) for r in sampling.stable_sample(spark.createDataFrame(part, kind).repartition(n), 0.2, rates).collect()}
            for part, n in ((rows[:700], 1), (list(reversed(rows)) + rows[:50], 5))
        )
        assert early <= late and 100 < len(late) < 700
    chosen = sampling.stable_sample(spark.createDataFrame(rows, kind), 0.2).collect()
    own = {r[0]: f"message:{r[0]}" if r[1] is None else str(int(float(r[1]))) for r in rows}
    kept = {r.conversation for r in chosen}
    assert {r.message_id for r in chosen} == {m for m, c in own.items() if c in kept}
    assert sampling.stable_sample(spark.createDataFrame([], kind)).count() == 0


def test_unit_interval(spark):
    u = [r[0] for r in spark.range(500).select(sampling.unit(F.col("id").cast("string"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.05


# -- near-duplicates and overlap ---------------------------------------------------------------------------------


def words(t):
    t = re.sub(r"@\w+", " ", re.sub(r"https?://\S+", " ", t or ""))
    return set(re.findall(r"[a-z0-9]+", re.sub(r"[\s.!?]*[\^~*/][A-Z]{1,3}\s*$", " ", t).lower()))


def near(a, b):
    a, b = words(a), words(b)
    return len(a) >= 6 and len(b) >= 6 and 10 * len(a & b) >= 7 * len(a | b)


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        t = rnd.sample(vocabulary, rnd.randrange(3, 25)) if not out or rnd.random() < 0.5 else rnd.choice(out).split()
        for _ in range(rnd.randrange(0, 5)):
            t = t[: -1 if rnd.random() < 0.4 else None] + rnd.sample(vocabulary, 1)
        rnd.shuffle(t)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("hot", [1, 40])
def test_near_duplicates_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(neardup.candidates, "__defaults__", (wordsets.SHARE, hot, 4))
    texts = corpus(hot, 220)
    rows = [(f"t_{i:03d}", t) for i, t in enumerate(texts)]
    extra = [("t_000", texts[0]), ("x1", None), ("x2", ""), (None, texts[0]), ("t_001", "@a " + texts[1].upper() + " https://t.co/1 ^AB")]
    df = spark.createDataFrame([(*r, 1) for r in rows + extra], "k string, t string, rep int")
    got = {(r.a, r.b) for r in neardup.pairs_of(*neardup.near_duplicates(df, "k", "t")).collect()}
    want = {(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[i + 1 :] if near(s, t)}
    assert got == want and len(want) > 30


@pytest.mark.parametrize("hot", [2, neardup.HOT])
def test_near_duplicates_of_few_common_words(spark, hot, monkeypatch):
    """Classes that have no word in common beyond a frequent n-gram are compared too."""
    monkeypatch.setattr(neardup.candidates, "__defaults__", (wordsets.SHARE, hot, neardup.LONGEST))
    rnd = random.Random(hot)
    texts = [f"a b c d e x{i}" for i in range(80)] + [f"f g h i j k l y{i} z{i}" for i in range(70)] + [f"f g h i j k l y{i}" for i in range(70, 75)] + ["f g h i j k l"]
    texts += sorted({" ".join(sorted(rnd.sample([f"w{i}" for i in range(11)], rnd.randrange(5, 10)))) for _ in range(90)})
    df = spark.createDataFrame([(f"t_{i:03d}", t) for i, t in enumerate(texts)], "k string, t string")
    got = {(r.a, r.b) for r in neardup.pairs_of(*neardup.near_duplicates(df, "k", "t")).collect()}
    want = {(f"t_{i:03d}", f"t_{j:03d}") for i, s in enumerate(texts) for j, t in enumerate(texts) if i < j and near(s, t)}
    assert len(got) == len(want) and got == want and len(want) > 80 * 79 // 2


def test_portions_cover_all_rows(monkeypatch):
    monkeypatch.setattr(neardup, "BATCH", 10)
    rng = np.random.default_rng(3)
    for n in ([], [25], [3, 4], rng.integers(1, 30, 40).tolist(), [10, 10, 10]):
        n = np.array(n, np.int64)
        parts = list(neardup._portions(n)) if len(n) else []
        assert [i for r, _ in parts for i in range(r.start, r.stop)] == list(range(len(n)))
        assert all(w.stop - w.start == n[r].sum() for r, w in parts) and [w.start for _, w in parts[1:]] == [w.stop for _, w in parts[:-1]]


def test_groups_and_empty(spark):
    t = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([("a", t), ("b", t), ("c", t + " eleven"), ("d", "short text")], "k string, t string")
    got = {r.id: (r.group_id, r.links) for r in neardup.groups_of(*neardup.near_duplicates(df, "k", "t")).collect()}
    assert set(got) == {"a", "b", "c"} and len({g for g, _ in got.values()}) == 1 and all(n == 1 for _, n in got.values())
    assert neardup.pairs_of(*neardup.near_duplicates(df.limit(0), "k", "t")).count() == 0


def conv(i):
    return [None, f"{i % 20}", f" {i % 20}", f"{i % 20}.0"][i % 4]


def test_overlap_equals_brute_force(spark):
    texts = corpus(9, 160)
    records = [(f"m_{i}", conv(i), "random" if i % 2 else None, t) for i, t in enumerate(texts[:80])] + [("m_1", conv(1), "Random", texts[1]), (None, "1", "random", texts[3]), ("m_e", None, "random", None)]
    exemplars = [(f"t_{i}", conv(i * 7), t, "b") for i, t in enumerate(texts[80:])] + [("t_0", conv(0), texts[80], "b"), ("t_e", None, "", "b")]
    e = spark.createDataFrame(records, "message_id string, conversation_id string, stratum string, input_text_redacted string")
    x = spark.createDataFrame(exemplars, "evidence_id string, conversation_id string, customer_text string, brand string")
    got = {(r.message_id, r.evidence_id) for r in overlap.overlaps(e, x).collect()}
    want = set()
    for m, c, s, t in records:
        for v, d, u, _ in exemplars:
            if m and s and ((c and d and float(c) == float(d)) or near(t, u)):
                want.add((m, v))
    assert got == want and len(want) > 20
    assert overlap.overlaps(e.limit(0), x).count() == 0 and overlap.overlaps(e, x.limit(0)).count() == 0


def passages(s):
    w = sorted(s)
    return set(zip(w, w[1:], strict=False))


def test_near_texts_share_enough_passages():
    rnd = random.Random(4)
    for _ in range(4000):
        u = rnd.randrange(6, 60)
        c = rnd.randrange(-(-7 * u // 10), u + 1)
        both = rnd.sample([f"w{i}" for i in range(90)], u)
        mine = rnd.randrange(u - c + 1)
        a, b = set(both[:c] + both[c : c + mine]), set(both[:c] + both[c + mine :])
        if min(len(a), len(b)) < 6:
            continue
        shared = passages(a) & passages(b)
        assert len(shared) >= max(overlap.least_shared(len(a)), overlap.least_shared(len(b)), 2 * c - u - 1)
        assert len({w for p in shared for w in p}) >= 2 * c - u
    with pytest.raises(ValueError):
        overlap.least_shared(20, 0.4)


def normalised(t):
    return " ".join(sorted(words(t)))


def test_scan_equals_brute_force_and_rests_on_the_automaton():
    texts = sorted({normalised(t) for t in corpus(5, 900) if len(words(t)) >= 6})
    held, given = texts[::2], texts[1::2]
    shard = overlap.Shard([f"r{i}" for i in range(len(held))], held)
    got = {(t, r): (c, v) for t, r, c, v in overlap.scan(shard, given)}
    want = {(t, r) for t, a in enumerate(given) for r, b in enumerate(held) if near(a, b)}
    assert set(got) == want and len(want) > 100
    for (t, r), (c, v) in got.items():
        a, b = words(given[t]), words(held[r])
        met = {w for p in passages(a) & passages(b) for w in p}
        assert c == len(a & b) and v == len(met) / len(b)
    # without the automaton's matches nothing is found; with only half of its passages pairs are lost
    half = type(shard.automaton)()
    for k, (p, v) in enumerate(list(shard.automaton.items())):
        if k % 2:
            half.add_word(p, v)
    half.make_automaton()
    shard.automaton = half
    assert len({(t, r) for t, r, _, _ in overlap.scan(shard, given)}) < len(want) / 2


def test_overlap_shards_and_classes(spark, monkeypatch):
    t = "one two three four five six seven eight nine ten"
    e = spark.createDataFrame([("m1", "5", "x", t), ("m2", None, "x", t), ("m3", "7.0", "x", t + " eleven"), ("m4", None, "x", None), ("m5", "5", None, t)], "message_id string, conversation_id string, stratum string, input_text_redacted string")
    x = spark.createDataFrame([("t1", " 5", t, "b"), ("t2", None, t, "b"), ("t3", "7", "ten nine eight seven six five four three two twelve", "b"), ("t4", "7", "", "b")], "evidence_id string, conversation_id string, customer_text string, brand string")
    monkeypatch.setattr(overlap.near_texts, "__defaults__", (wordsets.SHARE, 1))
    got = {r.message_id: (r.class_id, r.near_classes, r.near_exemplars, r.same_conversation) for r in overlap.overlap_classes(e, x).collect()}
    assert got == {"m1": ("m1", 2, 3, 1), "m2": ("m1", 2, 3, 0), "m3": ("m3", 2, 3, 2), "m4": ("m4", 0, 0, 0)}
    pairs = {(r.message_id, r.evidence_id) for r in overlap.overlaps(e, x).collect()}
    assert pairs == {(m, v) for m in ("m1", "m2", "m3") for v in ("t1", "t2", "t3")} | {("m3", "t4")}


def test_no_word_is_left_out():
    x = dict(zip(reading.NAMES, reading.features(" ".join(["word"] * 17)), strict=True))
    assert x["unit_words"] == np.log1p(17) and x["distinct"] == 1 / 17


# -- personal data -----------------------------------------------------------------------------------------------

GIVEN, FAMILY = "Mara Iven Tola Brisa Odo Keld Runa Pax".split(), "Hollbeck Marwick Tenfield Orlhurst Vannbury".split()


@pytest.fixture(scope="module")
def field():
    rnd = random.Random(2)
    name = lambda: f"{rnd.choice(GIVEN)} {rnd.choice(FAMILY)}"
    odd = lambda: "".join(rnd.choice(["bri", "xal", "tor", "nat", "quel", "low", "star", "tin", "vel", "har"]) for _ in range(3)).title()
    makers = [
        lambda: f"when {odd()} {odd()} was on it stopped",
        lambda: f"i told them {odd()} {odd()} skips at the end",
        lambda: f"please cancel {odd()} {odd()} today",
        lambda: f"my name is {name()}. please help",
        lambda: f"booking under {name()}, thanks",
        lambda: f"ask for {name()}.",
        lambda: f"mail me at {rnd.choice(GIVEN).lower()}@post.example now",
        lambda: f"call me on +44 7700 9{rnd.randrange(10**5):05d} please",
        lambda: f"passport no P{rnd.randrange(10**8):08d} ok",
        lambda: f"ticket #{rnd.randrange(10**8):08d}, order 123-{rnd.randrange(10**7):07d}-1234567",
        lambda: f"I live at {rnd.randrange(1, 99)} Plum Street, Orton.",
        lambda: f"the Velvet Street playlist by The {rnd.choice(FAMILY)} Lanterns",
        lambda: "Somewhere between Brixal Tornat and Quellow Startin it stops",
    ]
    return pii.fit([rnd.choice(makers)() for _ in range(900)])


def found(field, text):
    return [(text[s:e], pii.TYPES[t - 1]) for s, e, t in pii.Tagger(field)([text])[0]]


def test_personal_data_is_found(field):
    assert found(field, "hello, my name is Runa Marwick.") == [("Runa Marwick", "person_name")]
    assert found(field, "reply to runa (at) post (dot) example") == [("runa (at) post (dot) example", "email")]
    assert found(field, "ring +44 7700 900123 after six") == [("+44 7700 900123", "phone")]
    assert found(field, "passport no P12345678.") == [("P12345678", "id_number")]
    assert [k for _, k in found(field, "ship to 12 Plum Street, Orton")] == ["street_address"]


def test_other_things_are_not(field):
    for t in ("the Velvet Street playlist", "ticket #38028150", "[EMAIL] was masked", "@runa thanks", "Runa in chat was lovely", "version 9.26.32 on 14/11/2017", ""):
        assert found(field, t) == []


def test_redaction_keeps_the_rest(field):
    t = "hi, my name is Mara Tenfield\nand call me on +44 7700 900123!"
    assert pii.redact(t, pii.Tagger(field)([t])[0]) == "hi, my name is [NAME]\nand call me on [PHONE]!"


def without_skip(field):
    return pii.Field(field.weights, field.step, np.zeros_like(field.skip), field.given)


def test_every_mention_has_nodes_and_edges(field):
    lat = pii.lattice("ask for Runa Zelquist. later zelquist left, then runa zelquists came", field.given)
    assert [k for *_, k, _, _ in lat.spans].count("bare") == 1 and [k for *_, k, _, _ in lat.spans].count("again") == 1
    edges = pii.Batch([lat]).edges
    assert len(edges) >= 3 and set(edges[:, 4].tolist()) == {0, 1}


@pytest.mark.parametrize(
    "text",
    ["my name is Zorla Quenfield. the driver saw zorla quenfield outside", "my name is Zorla Quenfield. zorla quenfeild is on the slip", "ask for Orsa Hallwin. the door says orsa hallwin now"],
)
def test_skip_edges_decide_repeated_mentions(field, text):
    names = [x for x, k in found(field, text) if k == "person_name"]
    assert len(names) == 2 and len(found(without_skip(field), text)) == 1


def test_a_repeat_of_what_is_no_name_is_none(field):
    for t in ("the Velvet Harbor playlist by The Marwick Lanterns, they said velvet harbor is gone", "i told zorla quenfield about it. zorla quenfield said no"):
        assert found(field, t) == []


def test_unclear_spans_are_kept_and_refused():
    """The field against the makers of held-out texts, on spans for which the rules say nothing."""
    rnd = random.Random(6)
    made = []
    for k in range(1600):
        g, f = rnd.choice(GIVEN), rnd.choice(FAMILY)
        kind = k % 4
        clear = [f"my name is {g} {f}.", f"the {f} {g} playlist stops.", f"passport {rnd.randrange(10**9):09d} ok", f"ticket {rnd.randrange(10**9):09d} ok"][kind]
        silent = [f"{g} {f} at the counter said so.", f"ordered with {f} {g} on shuffle.", f"the form wants {rnd.randrange(10**9):09d} today", f"parcel slip {rnd.randrange(10**9):09d} came"][kind]
        made.append((clear if rnd.random() < 0.7 else f"{clear} {silent}", silent, kind in (0, 2)))
    f = pii.fit([t for t, *_ in made[:1200]])
    kept = refused = right = n = 0
    for _, t, true in made[1200:]:
        for s, e, ty, kind in pii.spans_of(t, pii._given_form(f.given)):
            if pii.rule(t, s, e, ty, kind, f.given) is not None:
                continue
            said = any(a < e and s < b for a, b, _ in pii.Tagger(f)([t])[0])
            n, kept, refused, right = n + 1, kept + said, refused + (not said), right + (said == true)
    assert n > 100 and kept > 20 and refused > 20, (n, kept, refused)


def test_messages_settle(field):
    lat = pii.lattice("my name is Zorla Quenfield. zorla quenfield, quenfield zorla, zorla and quenfield, zorla quenfields", field.given)
    b = pii.Batch([lat])
    assert np.abs(np.exp(pii.beliefs(field, b, b.allowed)[0]) - np.exp(pii.beliefs(field, b, b.allowed, 200)[0])).max() < 0.01


def test_a_saved_field_labels_alike(spark, field, tmp_path):
    pii.save(field, spark, str(tmp_path / "field"))
    back = pii.load(spark, str(tmp_path / "field"))
    texts = ["hello, my name is Runa Marwick.", "ring +44 7700 900123", "parcel for runa marwick", "the Velvet Street playlist"]
    assert pii.Tagger(back)(texts) == pii.Tagger(field)(texts) and back.given == field.given


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    u, step = rng.normal(size=(1, 4, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS))
    node, _ = pii._chains(u, step, np.ones((1, 4), bool))
    total = np.zeros((4, pii.LABELS))
    for path in np.ndindex(*[pii.LABELS] * 4):
        score = np.exp(sum(u[0, i, y] for i, y in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, y in enumerate(path):
            total[i, y] += score
    assert np.allclose(np.exp(node[0]), total / total.sum(1, keepdims=True))


def test_find_and_redact_tables(spark, field):
    name = "my name is Mara Tenfield"
    rows = [("f", "1", name), ("f", "1", name), ("f", "2", None), ("f", "3", ""), ("f", None, name), ("f", "4", "x" * 20000 + " call me on +44 7700 900123")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "field_name string, record_id string, text string, pii_type int")
    assert {tuple(r) for r in pii.find(df, field).collect()} == {("f", "1", "person_name"), ("f", "4", "phone")}
    back = {(r.record_id, r.text) for r in pii.redact_texts(df, field).collect()}
    assert ("2", None) in back and ("3", "") in back and ("1", "my name is [NAME]") in back
    assert pii.find(df.limit(0)).count() == 0


def test_given_names_come_from_all_texts(spark):
    df = spark.createDataFrame([(f"hello, my name is {g} {f}.",) for g in GIVEN for f in FAMILY], "text string")
    assert pii.learn(df, 5, 5).given == {g.lower() for g in GIVEN}


def test_copies_of_a_text_are_one_in_the_sample(spark, monkeypatch):
    texts = [f"ring +44 7700 900{i} please" for i in range(100, 140)]
    df = spark.createDataFrame([(t,) for t in texts for _ in range(50)], "text string")
    held = []
    monkeypatch.setattr(pii, "fit", lambda x, given: held.extend(x))
    monkeypatch.setattr(pii, "_FIELDS", {})
    pii.learn(df, 30, 20)
    assert len(held) == len(set(held)) == 20


def test_every_span_passes_the_prefilter(spark):
    texts = ["a b 07700\xa0900703", "the old mill, plum lane, orton", "esmer todd here", "ms orton", "hi mara tenfield, thanks", "Tenfield, Mara here", "12 Oak Close", "x at y dot com", "a@b.co", "Calle Mayor 7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    passed = {r.t for r in df.where(pii.possible(df.t)).collect()}
    assert all(t in passed for t in texts if pii.spans_of(t))


def test_spans_of_known_names_and_mixed_numbers_pass_the_prefilter(spark):
    given = frozenset({"anna", "jean-luc"})
    form = pii._given_form(given)
    texts = ["parcel for anna smith", "smith, anna has it", "to jean-luc vari", "for J. van Dyke today", "id C01X00T47 ok", "id AB1C2D3E4-5 ok", "anna-lena orton came"]
    df = spark.createDataFrame([(t,) for t in [*texts, "parcel for annabel smith"]], "t string")
    passed = {r.t for r in df.where(pii.possible(df.t, given)).collect()}
    assert [t for t in texts if pii.spans_of(t, form)] == texts[:-1] and passed >= set(texts[:-1])
    assert "parcel for annabel smith" not in passed


def test_lower_case_name_without_a_phrase_is_found(spark, field):
    df = spark.createDataFrame([("f", "1", "parcel for runa marwick")], "field_name string, record_id string, text string")
    assert [r.pii_type for r in pii.find(df, field).collect()] == [k for _, k in found(field, "parcel for runa marwick")] == ["person_name"]


FRAGMENTS = """mara Mara MARA tenfield Tenfield TENFIELD O'Brien o'brien Smith-Jones jean-luc Jean-Luc van de Von der St Street street STREET road Rd. Lane lane close Close Court place way Drive Square
hauptstraße Hauptstr. Musterweg calle Calle rue via Garcia 12 12b 12B 1200 flat Flat 4 apt. unit 07700 900123 +44 +1 (555) 555 123 4567 123-45-6789 123456789 AB123456C AB 34 56 C A12345678 AB1234567 AB-1234-5678-X
SMITH901015JJ9AB 85.07.30-033.28 C01X00T47 X7-99-1234-A mr Mr. mrs Dr. prof Herr J. J.K. J K. hi hello dear this is it was name of ask for booking under account holder: regards, cheers, cc attn: contact: thanks, here we by the
who a.b@c.de a (at) b (dot) com x at y dot &#64; ＠ info＠x.org order #12345678 and or in Rome stay , . ! ? … @acme ünal Ümit Émile Żak Иван Иванов Nguyễn Đặng x² 😀 0 1 2 3 5 6 7 8 9 0049 2024-01-01 shop playlist Paris""".split()


def test_the_prefilter_is_a_superset_on_random_texts(spark):
    rnd, given = random.Random(21), frozenset({"mara", "jean-luc"})
    seps = [" "] * 12 + ["", ", ", ". ", "\n", "  ", "-", "'", "\t", "\xa0", "/", "(", ")", ": "]
    texts = sorted({"".join(rnd.choice(FRAGMENTS) + rnd.choice(seps) for _ in range(rnd.randrange(1, 9))) for _ in range(15000)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    passed = {r.t for r in df.where(pii.possible(df.t, given)).collect()}
    form = pii._given_form(given)
    held = [t for t in texts if pii.spans_of(t, form)]
    assert len(held) > 3000 and [t for t in held if t not in passed] == []


# -- reading level -----------------------------------------------------------------------------------------------

LEVELS = {
    1: "The cat sat on the mat. I like it a lot. Put the key in the box. We can go now.",
    2: "Customers who changed their plan may notice that the new price appears on the following invoice. The driver left the parcel with a neighbour because nobody answered the door.",
    3: "Notwithstanding the provisional reinstatement of synchronisation privileges, subscribers whose entitlement derives from geographically restricted promotional arrangements must independently substantiate residency.",
}


def text_of(level, rnd, mixed=0.2):
    return " ".join(LEVELS[level if rnd.random() > mixed else rnd.randrange(1, 4)] for _ in range(9))


def test_levels_on_held_out_documents(spark):
    rnd = random.Random(4)
    truth = {i: rnd.randrange(1, 4) for i in range(240)}
    docs = [(i, text_of(b, rnd), "en", "s") for i, b in truth.items()] + [(900, None, "en", "s"), (901, "too short", "en", "s"), (902, text_of(1, rnd), "de", "s"), (None, text_of(1, rnd), "en", "s")]
    labels = [(i, f"r{j}", b if rnd.random() > 0.1 else rnd.randrange(1, 4)) for i, b in truth.items() if i < 120 for j in range(2)] + [(3, "r", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    y = spark.createDataFrame(labels, "doc_id bigint, rater string, band int")
    got = {r.doc_id: r.band for r in reading.reading_levels(d, y).collect()}
    assert set(got) == set(truth)
    assert np.mean([got[i] == truth[i] for i in truth if i >= 120]) > 0.9
    assert {r.band for r in reading.reading_levels(d, y.limit(0)).collect()} == {1}
    assert reading.reading_levels(d.limit(0), y).count() == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    y, w = rng.normal(size=50), rng.integers(1, 4, 50).astype(float)
    z = reading._pool(y, w)
    assert (np.diff(z) >= -1e-12).all() and abs((z * w).sum() - (y * w).sum()) < 1e-9
