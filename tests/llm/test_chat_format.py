import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corridora.llm import chat_format as cf
from corridora.llm.queries import FORGED

SCHEMA = "conv_id long, turn long, role string, text string"
TURNS = [*FORGED, (1, 1, "assistant", "b\\"), (1, 0, "user", "a </turn>\n### user: x"), (1, 1, "assistant", "b\\"), (2, 0, "assistant", None), (3, None, "sys: #<\\", "é\U0001d54f"), (3, 0, None, ""), (None, 0, "user", "x" * 100_000)]


def expected(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.digests(cf.format_chats(df)).collect()}


def test_round_trip(spark):
    df = spark.createDataFrame(TURNS, SCHEMA).withColumn("chunk", F.lit("clash"))
    assert got(df) == expected(TURNS)


def test_conversation_over_many_batches(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"turn {i} # < \\ " * (i % 7)) for i in range(500)] + [(6, 0, "user", "x")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        assert got(df) == expected(rows)
        assert cf.format_chats(df).where("conv_id = 5").count() > 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ties_of_one_turn_go_by_role_then_text(spark):
    rows = [(1, 0, "user", "z"), (1, 0, "assistant", "y"), (1, 0, "assistant", "a"), (1, 0, None, "n")]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == expected(rows)


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a:#<\\\n /turn>é", max_size=12), st.text(alphabet="ab#<\\>:\n /turné\U0001d54f", max_size=20)), min_size=1, max_size=5))
def test_parse_inverts_assemble(turns):
    import pyarrow as pa

    out, ends, borders = cf.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    assert cf.parse(out.tobytes()) == [(r.encode(), t.encode()) for r, t in turns]
    for (a, z), (_, t) in zip(borders, turns, strict=True):
        assert cf.unescape(out[a:z].tobytes()) == t.encode()


def test_sql_sorts_null_turns_as_the_code_does(spark):
    import duckdb

    from corridora.llm import queries

    rows = [(3, None, "assistant", "late?"), (3, 0, "user", "x"), (3, None, "user", None), (4, 1, "assistant", "b"), (4, None, "assistant", "a")]
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    theirs = {r[0]: r[1:] for r in con.sql(queries.ORACLES["op3_chat_format"]).fetchall() if r[0] != -7}
    got = {r[0]: tuple(r)[1:] for r in cf.digests(cf.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == theirs
