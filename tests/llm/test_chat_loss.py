"""What op10 takes from its segments."""

from pyspark.sql import functions as F

from readsearch.llm import chat

TURNS = [(1, 0, "user", "a&b"), (1, 1, "assistant", "x<[y]"), (2, 0, "user", "q")]


def test_op10_takes_loss_from_the_segments(spark, monkeypatch, tmp_path):
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    loss = lambda: {r["conv_id"]: r["loss_chars"] for r in chat.op10_chat(spark, str(tmp_path)).collect()}
    assert loss() == {1: 5, 2: 0, -7: 21}
    made = chat.format_chats
    flip = lambda s: F.struct(s["text"].alias("text"), ((s["kind"] == "text") & ~s["loss"]).alias("loss"), s["kind"].alias("kind"))
    monkeypatch.setattr(chat, "format_chats", lambda *a: made(*a).withColumn("segments", F.transform("segments", flip)))
    assert loss() == {1: 3, 2: 1, -7: 21}
