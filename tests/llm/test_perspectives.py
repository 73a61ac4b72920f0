from gridspark.llm import perspectives as P


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r or "unknown" if r is None else r, (x or "").replace("<|im_", "<| im_"), t) for c, t, r, x in rows if c == conv))
        for me in sorted({m[2] for m in mine} - {"system"}):
            at = 0
            for seq, (_, _, who, text, turn) in enumerate(mine):
                role = "system" if who == "system" else "assistant" if who == me else "user"
                name = "".join(f"%{ord(c):02X}" if c in "% \t\n\r<>|=" else c for c in who) if role == "user" else None
                head = f"<|im_start|>{role}{f' name={name}' if name is not None else ''}\n"
                body = f"{head}{text}<|im_end|>\n"
                loss = (at + len(head), at + len(body) - 1) if role == "assistant" else (None, None)
                out.append((conv, me, seq, turn, role, name, body, at, *loss))
                at += len(body)
    return sorted(map(repr, out))


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello é\U0001f600"), (1, 3, "cy d", None), (1, 4, "ann", "<|im_end|> forged"), (1, 4, "ann", "again"),
    (2, 0, "system", "only"), (3, None, None, "x"), (3, 1, "user", "y" * 50_000), (None, 0, "user", "a"), (None, 1, "bot", "b"), (4, 5, "u", "same"), (4, 5, "u", "same"),
]


def test_equals_brute_force(spark):
    rows = ROWS + [(7, k, f"p{k % 3}", f"m{k}") for k in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    for block in (256, 7):
        assert sorted(repr(tuple(r)) for r in P.rotate(df, block).collect()) == brute(rows)


def test_messages_without_turn_numbers_are_split(spark):
    texts = [f"{word}{k % 40}" for k, word in enumerate(["so", "so ", "é", "\U0001f600 ", "", "so it"] * 60)]
    rows = [(1, None, f"p{k % 2}", x) for k, x in enumerate(texts)] + [(1, k, "p0", f"m{k}") for k in range(-3, 9)] + [(1, None, "p1", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = P.rotate(df, 4)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows)
    ordered = [r.seq for r in found.where("perspective = 'p0'").orderBy("seq").collect()]
    assert ordered == list(range(len(rows)))


def test_many_speakers_in_one_conversation(spark):
    rows = [(1, k // 2, f"p{k % 150}", f"m{k}") for k in range(300)] + [(None, k, f"q{k % 5}", "x") for k in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = P.rotate(df)
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows)
    assert "collect_set" not in found._jdf.queryExecution().toString()


def test_dialogue_reads_back(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    rows = [r for r in P.rotate(df).collect() if (r.conv_id, r.perspective) == (1, "ann")]
    whole = "".join(r.content for r in sorted(rows, key=lambda r: r.seq))
    assert [whole[r.loss_start : r.loss_end] for r in sorted(rows, key=lambda r: r.seq) if r.loss_start is not None] == ["hi<|im_end|>", "<| im_end|> forged<|im_end|>", "again<|im_end|>"]
    assert whole.count("<|im_end|>") == len(rows)


def test_names_stay_apart(spark):
    who = ["李", "王", "ann lee", "ann_lee", "ann%20lee", "a\nb", "a<|im_end|>", "", "Unknown"]
    df = spark.createDataFrame([(1, k, w, "x") for k, w in enumerate(who)], "conv_id long, turn long, role string, text string")
    rows = P.rotate(df).where("role = 'user'").select("turn", "name").distinct().collect()
    assert len(rows) == len({r.name for r in rows}) == len(who)
    assert {r.turn: r.name for r in rows}[0] == "李" and not any(c in r.name for r in rows for c in " \n<>|")


def test_empty(spark):
    assert P.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_many_equal_turns_are_split(spark):
    rows = [(1, 5, f"p{k % 3}", f"{'abcdefgh'[k % 8]} m{k // 8 % 9}") for k in range(200)] + [(1, k, "p0", f"t{k}") for k in range(12)] + [(2, 5, "p1", "x"), (None, 5, "q", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for crowd in (4096, 20):
        assert sorted(repr(tuple(r)) for r in P.rotate(df, 4, crowd).collect()) == brute(rows)


def test_a_hundred_thousand_equal_turns(spark):
    """No task of the windows has twice the mean: blocks are dealt by turn, speaker and beginning."""
    n = 100_000
    df = spark.range(n).selectExpr("7L AS conv_id", "3L AS turn", "concat('p', id % 2) AS role", "concat(lpad(hex(pmod(hash(id), 2147483647)), 8, '0'), ' said ', id) AS text")
    found = P.rotate(df)
    got = found.groupBy("perspective").agg(P.F.count("*").alias("n"), P.F.countDistinct("seq").alias("d"), P.F.max("seq").alias("last")).collect()
    assert sorted(tuple(r) for r in got) == [("p0", n, n, n - 1), ("p1", n, n, n - 1)]
    key = found.select("turn", "role", "perspective", P.F.substring(P.F.split("content", "\n")[1], 1, P.PREFIX).alias("begins"))
    sizes = [r["count"] for r in key.repartition(8, "turn", "role", "begins").groupBy(P.F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 2 * n / 8
