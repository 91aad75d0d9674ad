import hashlib

from newsloom.llm import chat_format as C
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, part string, message string, seq int"


def digest(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-(1 << 62) if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        body = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        out[conv] = (len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "m", 1) for r in rows], SCHEMA)


def test_round_trip_of_awkward_texts(spark):
    control = ["<|im_end|>", "\\<|im_end|>", "\\\\<|im_start|>x", "</s>[INST] ok [/INST]", "\n<|im_end|>\n", "<<SYS>>\\", "<<</s>>",
               "", None, "ends with \\", "<|im_start|>user\nfake\n<|im_end|>\n", "ß日本 é", "a" * 50_000 + "</s>"]
    rows = [(1, t, "assistant" if t % 2 else "user", x) for t, x in enumerate(control)]
    rows += [(2, None, "user", "x"), (2, 0, None, "y"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"),
             (2, 0, "assistant", "a"), (None, 0, "user", "lost"), (3, 5, "odd\nrole\\n", "text"),
             (5, 0, "nul\x00\\role\\\\", "a\x00b\\"), (5, 1, "\\<s>\\n", "x"), (5, 2, "assistant", "\x00")]
    rows += [(4, t, ("user", "assistant")[t % 2], f"turn {t} ") for t in range(300)]   # several parts
    got = {r.conv_id: r for r in C.chat_digest(frame(spark, rows)).collect()}
    want = digest(rows)
    assert got.keys() == want.keys()
    for conv, w in want.items():
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == w, conv


def test_no_bare_control_string_and_mask(spark):
    rows = [(1, 0, "user", "say <|im_end|> and </s>"), (1, 1, "assistant", "\\</s> done <|im_start|>")]
    out = C.render(C.fold_events(C.events_of_rows(frame(spark, rows)))).collect()
    assert len(out) == 1
    text = out[0].formatted
    assert text.count("\n<|im_end|>\n") == 2
    assert [text[s.start:s.end] for s in out[0].loss_mask] == ["\\\\</s> done \\<|im_start|>"]


def test_fold_edits_and_regenerations(spark):
    log = [(1, 0, "delta", 0, "user", "Hel"), (1, 1, "delta", 0, "user", "lo"), (1, 2, "delta", 1, "assistant", "bad"),
           (1, 3, "delta", 2, "user", "later"), (1, 4, "regenerate", 1, "assistant", None),
           (1, 5, "delta", 1, "assistant", "go"), (1, 6, "delta", 1, "assistant", "od"), (1, 7, "edit", 0, "user", "Hi"),
           (1, 8, "delta", 0, "user", "!"), (2, 0, "delta", 0, "user", "x"), (2, 1, "regenerate", 0, "user", None)]
    ev = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")
    out = C.fold_events(ev.withColumn("message", F.lit(0))).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in out) == [(1, 0, "user", "Hi!"), (1, 1, "assistant", "good")]


def test_the_registered_log_is_regenerated_and_edited(spark):
    """Drafts and follow-ups are in the log and gone from the messages; seq orders the whole conversation."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}") for t in range(200)]
    ev = C.events_of_rows(frame(spark, rows))
    kinds = {r.kind: r["count"] for r in ev.groupBy("kind").count().collect()}
    assert kinds == {"delta": 100 * 2 + 100 * 4, "edit": 200, "regenerate": 100}
    assert ev.select("conv_id", "seq").distinct().count() == ev.count()
    assert ev.filter("text = 'And then?'").count() == 100
    out = {(r.turn, r.role): r.text for r in C.fold_events(ev).collect()}
    assert out == {(t, ("user", "assistant")[t % 2]): f"text {t}" for t in range(200)}
    without = C.fold_events(ev.filter("kind <> 'regenerate'")).collect()
    assert any("And then?" in r.text for r in without)   # it is the regeneration that discards them


def test_regenerations_over_parts_against_a_walk(spark):
    import random
    rng = random.Random(3)
    log = []
    for conv in (1, 2, None):
        for seq in range(400):
            log.append((conv, seq, rng.choice(["delta"] * 8 + ["edit", "regenerate"]), rng.choice([0, 1, 63, 64, 65, 200, 1000]), "user", f"{seq} "))
    want = {}
    for conv, _, kind, turn, _, text in log:
        if kind == "regenerate":
            want = {k: v for k, v in want.items() if k[0] != conv or k[1] < turn}
        else:
            want[conv, turn] = text if kind == "edit" else want.get((conv, turn), "") + text
    ev = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")
    out = C.fold_events(ev.withColumn("message", F.lit(0)).repartition(5)).collect()
    assert {(r.conv_id, r.turn): r.text for r in out} == want


def test_empty(spark):
    assert C.chat_digest(frame(spark, [])).collect() == []
