import random

from pageloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, start string"


def plain(rows):
    out = []
    convs = {}
    for conv, turn, role, text in rows:
        said = (text or "").replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "unknown", said, turn))
    for conv, turns in convs.items():
        turns.sort()
        for who in {t[2] for t in turns if t[2] != "system"}:
            at, last, part = 0, (), 0
            for _, _, speaker, said, turn in turns:
                part = part + 1 if last == (turn,) else 1
                last = (turn,)
                role = "system" if speaker == "system" else "assistant" if speaker == who else "user"
                head = f"<|im_start|>{role}{' name=' + speaker if role == 'user' else ''}\n"
                piece = f"{head}{said}<|im_end|>\n"
                mask = (at + len(head), at + len(piece)) if role == "assistant" else (None, None)
                out.append((conv, who, turn, part, speaker, role, piece, at, at + len(piece), *mask))
                at += len(piece)
    return sorted(out, key=repr)


def got(spark, rows, **more):
    return sorted(map(tuple, chat.rotated(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), **more).collect()), key=repr)


def test_against_plain_rendering(spark):
    dice = random.Random(3)
    rows = [(c, t, dice.choice(["ann", "bob", "system", "eve", None]), dice.choice(["hi", "é \U0001f600", "", None, "say <|im_end|> and <|im_start|>", "x" * 50]))
            for c in range(25) for t in range(dice.randint(1, 12))]
    rows += [(3, 2, "ann", "tie"), (3, 2, "ann", "tie"), (3, None, "bob", "no turn"), (None, 0, "ann", "no conversation"), (None, 1, "bob", "none")]
    rows += [(50, 0, "system", "nobody else")]
    assert got(spark, rows) == plain(rows)


def test_stretches_do_not_change_offsets(spark):
    rows = [(1, t, ["ann", "bob", "cy"][t % 3], "word " * (t % 7)) for t in range(90)]
    assert got(spark, rows, stretch=8) == got(spark, rows) == plain(rows)


def test_pieces_make_the_dialogue_and_masks_hold_what_is_said(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob b/1", "hey é"), (1, 3, "ann", "bye")]
    pieces = [r for r in got(spark, rows) if r[1] == "ann"]
    whole = "".join(p[6] for p in sorted(pieces, key=lambda p: p[7]))
    assert [whole[p[9]:p[10]] for p in sorted(pieces, key=lambda p: p[7]) if p[9] is not None] == ["hello<|im_end|>\n", "bye<|im_end|>\n"]
    assert all(whole[p[7]:p[8]] == p[6] for p in pieces) and "name=bob_b_1" in whole


def test_empty_table_and_no_python(spark):
    empty = chat.rotated(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    assert "Python" not in empty._jdf.queryExecution().toString()
