import base64

import pytest
from pyspark.sql import functions as F

from threadloom.functions import blocks as B
from threadloom.plans.engine import ContextEngine
from threadloom.plans.strategies import Autobiographical, Budget, Config
from threadloom.sources import message_log


@pytest.fixture
def engine(spark, tmp_path):
    return ContextEngine(spark, str(tmp_path / "store"))


def texts(frame):
    return [[b["text"] for b in r["content"]] for r in frame.collect()]


def test_messages(engine):
    a, b, c = (engine.add_message("User", t, {"external": {"source": "mail", "id": t}, "n": k}) for k, t in enumerate(("one", "two", "three")))
    assert texts(engine.get_all_messages()) == [["one"], ["two"], ["three"]]
    engine.edit_message(b, "TWO")
    seen = engine.get_message(b)
    assert seen["content"][0]["text"] == "TWO" and seen["participant"] == "User" and seen["pos"] == 1
    assert engine.get_message_at(b, 3)["content"][0]["text"] == "two"
    engine.remove_message(b)
    assert engine.get_message(b) is None and engine.get_message(c)["pos"] == 1
    with pytest.raises(KeyError):
        engine.edit_message(b, "x")
    assert [r["msg_id"] for r in engine.query_messages(metadata={"n": 2}).collect()] == [c]
    assert engine.query_messages(metadata={"n": "2"}).count() == 0
    assert engine.query_messages(external_ids=[], limit=1).first()["total_count"] == 2
    assert engine.find_message_by_external_id("mail", "one")["msg_id"] == a
    assert engine.find_message_by_external_id("mail", "nine") is None
    assert engine.stats() == {"messages": 2, "context_entries": 0, "branches": 1}


def test_range_removal_leaves_entries(engine):
    found = [engine.add_message("User", str(k)) for k in range(4)]
    for m in found:
        engine.append_entry("User", "copy", m, "copy")
    engine.remove_messages(found[1], found[2])
    assert texts(engine.get_all_messages()) == [["0"], ["3"]] and engine.entries().count() == 4
    engine.remove_message(found[0])
    assert engine.entries().count() == 3


def test_edits_reach_copies_only(engine):
    m = engine.add_message("User", "before")
    for relation in ("copy", "derived", "referenced", None):
        engine.append_entry("User", "before", m, relation)
    engine.edit_message(m, "after")
    got = {r["source_relation"]: r["content"][0]["text"] for r in engine.entries().collect()}
    assert got == {"copy": "after", None: "after", "derived": "before", "referenced": "before"}


def test_branches(engine):
    a = engine.add_message("User", "a")
    engine.add_message("User", "b")
    name = engine.branch_at(a, "side")
    engine.switch_branch(name)
    assert texts(engine.get_all_messages()) == [["a"]]
    engine.add_message("User", "c")
    assert texts(engine.get_all_messages()) == [["a"], ["c"]] and engine.current_branch()["id"] == "side"
    engine.switch_branch("main")
    assert texts(engine.get_all_messages()) == [["a"], ["b"]] and engine.list_branches().count() == 2
    with pytest.raises(KeyError):
        engine.switch_branch("none")


def test_media_are_stored_once(engine):
    image = {"type": "image", "source_type": "base64", "media_type": "image/png", "data": base64.b64encode(b"pixels").decode(), "token_estimate": 5}
    a, b = engine.add_message("User", [image]), engine.add_message("User", [{"type": "text", "text": "x"}, image])
    assert engine.blobs().count() == 1
    back = engine.get_message(b)["content"]
    assert [x["type"] for x in back] == ["text", "image"] and base64.b64decode(back[1]["data"]) == b"pixels" and back[1]["token_estimate"] is None
    assert engine.messages().filter(F.col("msg_id") == a).first()["content"][0]["type"] == "blob_ref"


def test_missing_media_stop(spark, engine):
    engine.add_message("User", [{"type": "blob_ref", "blob_hash": "no", "original_type": "image"}])
    with pytest.raises(Exception, match="Blob not found"):
        engine.get_all_messages().collect()


def test_namespaces_and_reopening(spark, tmp_path):
    one = ContextEngine(spark, str(tmp_path), "agent", isolate=True)
    two = ContextEngine(spark, str(tmp_path))
    one.add_message("User", "mine")
    assert one.messages().count() == 1 and two.messages().count() == 0
    assert ContextEngine(spark, str(tmp_path), "agent", isolate=True).messages().count() == 1
    with pytest.raises(ValueError):
        ContextEngine(spark, isolate=True)
    one.close()
    assert one.is_closed()
    with pytest.raises(RuntimeError):
        one.add_message("User", "late")


def test_compile_tick_and_topic(engine, capsys):
    engine.set_strategy(Autobiographical(Config(target_chunk_tokens=10, recent_window_tokens=30, head_window_tokens=20, summary_target_tokens=10)))
    heard = []
    off = engine.add_listener(heard.append)
    for k in range(14):
        engine.add_message("User" if k % 2 else "Claude", "word " * 8)
    off()
    assert [e["type"] for e in heard] == ["add"] * 14 and not engine.is_ready()
    engine.tick()
    assert engine.is_ready()
    entries, system = engine.compile(Budget(1000, 0), [{"namespace": "rag", "position": "beforeUser", "content": "facts"}])
    who = [r["participant"] for r in entries.collect()]
    assert "Context Manager" in who and "injection:rag" in who and system.count() == 0
    engine.log_compiled(entries, out=__import__("sys").stdout)
    assert "injection:rag" in capsys.readouterr().out
    again = ContextEngine(engine.spark, engine.path, strategy=engine.strategy)
    assert again.compile(Budget(1000, 0))[0].filter("participant = 'Context Manager'").count() == 1
    text = engine.reset_head_window("new subject")
    assert text == "new subject" and engine.compile(Budget(1000, 0))[0].first()["content"][0]["text"].startswith(B.TRANSITION_PREFIX)
    assert engine.reset_head_window() != ""
    engine.set_strategy(type(ContextEngine(engine.spark).strategy)())
    with pytest.raises(TypeError):
        engine.reset_head_window("x")


def test_unknown_ids_stop_bulk_edits(spark, engine):
    engine.add_message("User", "a", msg_id="m1")
    change = spark.createDataFrame([("main", "nope", 9)], "session string, msg_id string, seq long")
    with pytest.raises(Exception, match="Message not found"):
        message_log.removals(engine.messages(), change).collect()
