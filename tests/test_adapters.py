from mnemospark.sources.adapters import ChatStore, TextVectorStore
from mnemospark.sources.engine import Engine


def embed(texts):
    return [[float(t.count("a")), float(t.count("b")), 1.0] for t in texts]


def test_texts(spark, tmp_path):
    with Engine.open(spark, str(tmp_path / "s")) as e:
        s = TextVectorStore.from_texts(["aaa", "bbb", "ab"], e, embed, [{"n": 1}, {"n": 2}, {"n": 3}])
        assert s.similarity_search("aa", 1) == ["aaa"]
        text, meta, score = s.similarity_search_with_score("bb", 4, {"n": {"$lt": 3}})[0]
        assert (text, meta) == ("bbb", {"n": 2}) and score < 0.1
        ids = s.add_texts(["aab", "abb"], ref_doc_id="doc")
        assert s.delete_ref_doc("doc") == 2 and s.delete_ref_doc("doc") == 0
        s.delete(ids)
        assert len(s.similarity_search("a", 10)) == 3 and s.add_texts([]) == []


def test_chat(spark, tmp_path):
    with Engine.open(spark, str(tmp_path / "s")) as e:
        c = ChatStore(e)
        c.set_messages("k", [("user", "1"), ("assistant", "2"), ("user", "3")])
        c.add_message("other", "user", "x")
        assert c.get_messages("k") == [("user", "1"), ("assistant", "2"), ("user", "3")] and c.keys() == ["k", "other"]
        assert c.delete_message("k", 1) == ("assistant", "2") and c.delete_last_message("k") == ("user", "3") and c.delete_message("k", 9) is None
        assert c.transcript("k") == "Human: 1" and c.transcript("none") == ""
        c.set_messages("k", [("ai", "z")])
        assert c.get_messages("k") == [("ai", "z")]
        c.delete_messages("k")
        assert c.keys() == ["other"] and c.get_messages("k") == []
