"""Media archives and chat masks: exact round trips."""

import hashlib
import re
import zlib

import pytest

from quern.llm import chat, media
from quern.llm.common import shared_dir


def test_media_of_odd_documents(spark, docs, no_docs):
    rows = media.media_round_trip(docs, archive_bytes=2000).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    by_text: dict = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        by_text.setdefault(texts[r.doc_id], set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.media_round_trip(no_docs).count() == 0


def test_byte_ranges_cover_each_member_once(spark, docs):
    folder = shared_dir(spark, "ranges")
    media.write_archives(docs, folder, archive_bytes=500)
    spark.dataSource.register(media.MemberArchive)
    small = spark.read.format("member_archive").option("range_bytes", 100).load(folder)
    assert small.count() == docs.count()
    assert small.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_a_failed_member_is_fetched_again(spark, docs, tmp_path, monkeypatch):
    folder = shared_dir(spark, "again")
    archive = media.write_archives(docs, folder).first().archive
    reader = media.MemberReader({"path": folder})
    real, calls = media.member_bytes, []

    def flaky(file, member):
        calls.append(member.header_offset)
        if len(calls) == 1:
            raise OSError("lost")
        return real(file, member)

    monkeypatch.setattr(media, "member_bytes", flaky)
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    batches = list(reader.read(media.ByteRange(archive, 0, 1 << 60)))
    assert calls[0] == calls[1] and len(set(calls)) == len(calls) - 1 == sum(len(b) for b in batches)


def test_damage_is_noticed():
    good = media.encode_media("some text")
    assert media.decode_media(good)[1].startswith(b"some text")
    with pytest.raises(ValueError):
        media.decode_media(good[:40] + b"x" + good[41:])


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello <|close|> there"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "é🙂 <\\|turn|> x"),
    (2, 0, None, "no role"), (3, 5, "assistant", "  lead and trail \n"), (3, 5, "assistant", "  lead and trail \n"), (None, 0, "user", "null conversation"),
    (4, 0, "assistant", "<"), (4, 1, "assistant", "|body|> <|endoftext|>"), (5, 0, "assistant", "word " * 20000), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def test_chat_round_trip(spark):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS ids", "2 AS formatted")
    formatted = chat.format_conversations(table)
    rows = {r.conv_id: r for r in chat.digest_formatted(formatted).collect()}
    groups: dict = {}
    for conv, turn, role, text in sorted(TURNS, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        groups.setdefault(conv, []).append((role or "", text or ""))
    assert rows.keys() == groups.keys()
    for conv, turns in groups.items():
        r = rows[conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.render(turns)[0])


def test_escape_is_reversible():
    import random

    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice(["<", "|", "\\", "a", "turn", ">", "<|turn|>"]) for _ in range(rng.randint(0, 10)))
        assert chat.unescape(chat.escape(text)) == text
        assert not re.search(r"<\|", chat.escape(text))


def test_no_conversations(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest_formatted(chat.format_conversations(table)).count() == 0
