from profilescope.llm import dialogues
from profilescope.llm.dialogues import rotate

ROWS = [
    (1, 0, "system", "Seid nett.", "x"), (1, 1, "anna", "Hallo <|end|>", "x"), (1, 2, "ben", "Tag", "x"),
    (1, 3, "cleo", None, "x"), (1, 3, "anna", "Ö\U0001f600", "x"), (1, 300, "ben", "Bis bald", "x"), (1, 300, "ben", "Bis bald", "x"),
    (1, None, "ben", "vorab", "x"), (2, 0, None, "wer?", "x"), (2, 1, "anna", "", "x"), (3, 0, "system", "allein", "x"),
    (None, 0, "anna", "nirgends", "x"),
]


def told():
    out = []
    for conv in (1, 2, 3):
        turns = {(t, r or "unknown", (x or "").replace("<|", "< |")) for c, t, r, x, _ in ROWS if c == conv}
        ordered = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        for who in {r for _, r, _ in turns} - {"system", "unknown"}:
            at = 0
            for position, (_, speaker, text) in enumerate(ordered):
                role = "system" if speaker == "system" else "assistant" if speaker == who else "user"
                head = f"<|user:{speaker}|>" if role == "user" else f"<|{role}|>"
                segment = head + text + "<|end|>\n"
                mine = role == "assistant"
                out.append((
                    conv, who, position, role, speaker if role == "user" else None, segment, at, at + len(segment),
                    at + len(head) if mine else None, at + len(segment) if mine else None,
                ))
                at += len(segment)
    return sorted(out, key=str)


def test_rotation(spark, monkeypatch):
    for chunk in (128, 1, 10**6):
        monkeypatch.setattr(dialogues, "CHUNK", chunk)
        frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, segment string")
        assert sorted(map(tuple, rotate(frame.repartition(3)).collect()), key=str) == told()
    assert rotate(frame.where("false")).count() == 0
