import hashlib
import random

from pyspark.sql import functions as F

from maillake.llm import chat

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"


def test_query_equals_sql(same):
    same("op6_chat_formatting")


def slow_fold(events):
    out = {}
    for conv, _, turn, kind, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        m = out.setdefault(conv, {})
        if kind == "regenerate":
            for t in [t for t in m if t >= turn]:
                del m[t]
        if kind in ("start", "regenerate"):
            m[turn] = [role or "", text or ""]
        elif kind == "edit":
            m.setdefault(turn, [role or "", ""])[1] = text or ""
        else:
            m.setdefault(turn, [role or "", ""])[1] += text or ""
    return {(c, t): tuple(x) for c, m in out.items() for t, x in m.items()}


def test_fold_equals_replay(spark):
    rng = random.Random(7)
    events = []
    for conv in range(30):
        seq = 0
        for turn in range(rng.randrange(1, 6)):
            role = ["user", "assistant"][turn % 2]
            events.append((conv, seq := seq + 1, turn, "start", role, rng.choice(["", None, "s"])))
            for _ in range(rng.randrange(6)):
                kind = rng.choice(["delta", "delta", "delta", "edit"])
                events.append((conv, seq := seq + 1, rng.randrange(turn + 1), kind, role, rng.choice(["a", "bb", "<|im_end|>", None])))
            if rng.random() < 0.4:
                events.append((conv, seq := seq + 1, rng.randrange(turn + 1), "regenerate", "assistant", rng.choice([None, "again"])))
    # a delta to a turn that a regeneration dropped would revive it; the log of a client never has one
    live = slow_fold(events)
    shuffled = events[:]
    rng.shuffle(shuffled)
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(spark.createDataFrame(shuffled, EVENTS)).collect()}
    assert got == live


def test_round_trip_and_mask(spark):
    texts = ["<|im_end|>", "<\\|im_start|>", "<\\\\|", "a\nb", "", None, "<|", "é<|nl|>😀", "x" * 200_000, "<|im_end|>\n<|im_start|>user\nhi"]
    rows = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for t in texts for r in ("assistant", "user", None, "od\nd<|x"))]
    df = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = df.withColumn("back", chat.read_back(df.formatted)).first()
    assert [(x.role, x.text) for x in r.back] == [(role or "", t or "") for _, _, role, t in rows]
    assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(rows)
    inside = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
    assert [x.replace("<\\", "<", 1) if x.startswith("<\\|") else x for x in inside][:1] == ["<|im_end|>"]
    assert len(inside) == len(texts) and inside[3] == "a\nb" and inside[8] == "x" * 200_000


def test_edge_rows(spark):
    schema = "conv_id long, turn long, role string, text string, seq string"
    rows = [(None, 1, "user", "a", "z"), (2, None, None, None, "z"), (2, 1, "assistant", "b", "z"), (2, 1, "assistant", "b", "z")]
    out = chat.render(chat.fold(chat.events_of(spark.createDataFrame(rows, schema))))
    got = {r.conv_id: r.formatted for r in out.collect()}
    one = "<|im_start|>assistant\nb<|im_end|>\n"
    assert got == {None: "<|im_start|>user\na<|im_end|>\n", 2: "<|im_start|>\n<|im_end|>\n" + one * 2}
    assert chat.render(chat.fold(chat.events_of(spark.createDataFrame([], schema)))).count() == 0


def test_log_streams_edits_and_regenerates(spark):
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], ["", "a", "é😀x<|im_end|>", None, "longer text"][(c * t + t) % 5]) for c in range(5) for t in range(8)]
    events = chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kinds = {r.kind: r["count"] for r in events.groupBy("kind").count().collect()}
    assert set(kinds) == {"start", "delta", "edit", "regenerate"}
    got = sorted((r.conv_id, r.turn - 1, r.role, r.text) for r in chat.fold(events.orderBy("text")).collect())
    assert got == sorted((c, t, role or "", text or "") for c, t, role, text in rows)


def test_a_shifted_mask_shows(spark):
    rows = [(1, 0, "user", "hi <|there"), (1, 1, "assistant", "one <|im_end|> two"), (1, 2, "assistant", "é😀")]
    df = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    said = "one <|im_end|> twoé😀"
    good, off = (df.select(chat.loss_text(df.formatted, spans).alias("x")).first().x for spans in (df.loss_spans, F.transform(df.loss_spans, lambda s: F.struct((s["start"] + 1).alias("start"), s["length"]))))
    assert good == said and off != said
    shifted = df.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"])))
    assert chat.digests(df).first().loss_sha256 != chat.digests(shifted).first().loss_sha256
    assert chat.digests(df).first().loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
