import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voltlane.llm import chat, pieces, repair, sp_codec, token_count
from voltlane.llm.queries import ORACLE_SQL, op2_sentencepiece, op4_chat_format, op5_token_count, op6_token_files

DOC = "doc_id long, text string, n_tokens string"
ODD = ["", None, " ", "  a", "a  b ", "\n", "\n\n x", "a\tb", "Hello <s> </s> <unk>", "ﬁ é x y", "a\r\nb\x00c", "<0x41>", "😀 漢字テスト kanji", "a" * 300, "." * 200, " " * 100 + "x" + " " * 33, "1234567890" * 10, "▁a b▁c", "x². y²z", "<|endoftext|> It's <|ENDOFTEXT|>", "word " * 30000]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def noise(n=400):
    rng = random.Random(5)
    return ["".join(rng.choice("abcdeiou .,\nthngsr▁0é漢#'-²") for _ in range(rng.randint(0, 150))) for _ in range(n)]


def test_op2_ids_are_the_librarys_and_come_back(spark, sf, library):
    texts = [*ODD, *noise()]
    rows = sp_codec.decode(sp_codec.encode(frame(spark, texts)), out="back").collect()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode(t)
        assert r["back"] == t.replace(pieces.MARK, " ")
    both = sp_codec.recode(frame(spark, texts)).select("doc_id", "coded.*").collect()
    assert {r["doc_id"]: (r["ids"], r["text"]) for r in both} == {r["doc_id"]: (r["ids"], r["back"]) for r in rows}
    assert all(r["round_trip"] for r in op2_sentencepiece(spark, sf).collect())
    assert sp_codec.encode(frame(spark, [])).count() == 0


def test_streaming_search_commits_early_and_equals_a_whole_search(library):
    coder = sp_codec.coders(pieces.default_model())[0]
    for t in noise(60):
        chars = pieces.MARK + t.replace(" ", pieces.MARK)
        assert list(coder.stream(chars)) == (library.encode(t) or list(coder.stream(chars)))
    read = 0

    def feed():
        nonlocal read
        for c in "▁the▁quick▁brown▁fox" * 500:
            read += 1
            yield c

    next(coder.stream(feed()))
    assert read <= 4 * coder.vocab.longest


def test_short_pretokens_go_in_step_and_long_ones_as_streams(library, monkeypatch):
    vocab = pieces.vocabulary(pieces.default_model())
    texts = [t or "" for t in [*ODD, *noise()]]
    streamed = []
    stream = sp_codec.Encoder.stream
    monkeypatch.setattr(sp_codec.Encoder, "stream", lambda self, chars: streamed.append(chars) or stream(self, chars))
    for memo, bits, held in ((sp_codec.MEMO, sp_codec.PAIR_BITS, pieces.HELD), (20, 3, 7)):
        monkeypatch.setattr(sp_codec, "PAIR_BITS", bits)
        monkeypatch.setattr(sp_codec, "IN_STEP", held)
        monkeypatch.setattr(pieces, "HELD", held)
        coder = sp_codec.Encoder(vocab, memo=memo, pair_memo=memo)
        for block in (texts, texts[:5], ["word one " * (1 + sp_codec.BLOCK_BYTES // 9)], []):
            got = coder.packed_all(block)
            assert [np.frombuffer(r, np.int32).tolist() for r in got] == [library.encode(t) for t in block]
            assert len(coder.seen) + len(coder.older) <= memo and len(coder.apart) <= memo
    assert streamed and all(len(s) >= 2 * vocab.longest for s in streamed)


def test_suffixes_are_those_of_the_pieces():
    vocab = pieces.vocabulary(pieces.default_model())
    table, suffixes = pieces.Suffixes(vocab.ids), {p[i:] for p in vocab.ids for i in range(len(p))}

    def walk(text):
        node = 0
        for code in table.encoded([text]).tolist()[::-1]:
            step = table.base[node] + code
            if table.behind[step] != node:
                return None
            node = step
        return int(table.piece[node])

    rng = random.Random(3)
    others = ["".join(rng.choices([*"aeinrst▁é漢😀"], k=rng.randint(1, 6))) for _ in range(5000)]
    assert all(walk(s) == vocab.ids.get(s, -1) if s in suffixes else walk(s) is None for s in [*suffixes, *others])


def test_words_of_common_letters_are_the_same_pretokens():
    cuts = pieces.vocabulary(pieces.default_model()).cuts
    general = re.compile(cuts.pattern[cuts.pattern.index("\n|") :])
    assert general.pattern != cuts.pattern
    rng = random.Random(3)
    for _ in range(5000):
        t = "".join(rng.choices("abcdeiouéßżʰɐªºµÿ×÷²³½١Ⅷⅷ一漢ー_-'.,▁▁▁\n\n 09ǅ😀𝒜𐐀", k=rng.randint(1, 40)))
        assert cuts.findall(t) == general.findall(t)


def test_unigram_search_matches_brute_force():
    class Tiny:
        pieces = ["a", "b", "ab", "aba", "bb", "ba"]
        scores = [-1.0, -1.1, -1.5, -2.9, -1.9, -2.0]
        ids = {p: i for i, p in enumerate(pieces)}
        longest, bytes, unknown = 3, {}, 0

    coder = sp_codec.Encoder(Tiny(), unigram=True)
    rng = random.Random(2)
    for _ in range(100):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30)))
        best = [0.0] + [-1e9] * len(t)
        for i in range(1, len(t) + 1):
            best[i] = max(best[j] + Tiny.scores[Tiny.ids[t[j:i]]] for j in range(max(0, i - 3), i) if t[j:i] in Tiny.ids)
        got = list(coder.stream(t))
        assert "".join(Tiny.pieces[k] for k in got) == t
        assert abs(sum(Tiny.scores[k] for k in got) - best[-1]) < 1e-9


def test_op5_counts_are_the_librarys(spark, sf, library):
    texts = [*ODD, *noise()]
    rows = token_count.count_tokens(frame(spark, texts).drop("n_tokens").withColumn("more", F.lit(1))).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(library.encode(t or "")) for i, t in enumerate(texts)}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op5_token_count(spark, sf).collect():
        n = len(library.encode(docs[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 4096)


def brute_index(texts):
    tok = Tokenizer.from_file(public_tokenizers.path(repair.MODEL))
    out, start = {}, 0
    for d in sorted(texts):
        ids = [*tok.encode(texts[d] or "", add_special_tokens=False).ids, 1]
        out[d] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)), ids)
        start += len(ids)
    return out


def test_op6_files_hold_the_librarys_ids(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute_index(docs)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op6_token_files(spark, sf).collect()}
    assert got == {d: w[:3] for d, w in want.items()}


def test_op6_odd_texts_many_shards_and_random_access(spark, tmp_path):
    texts = dict(enumerate([*ODD, *noise(80), "the cat of the cat " * 2000]))
    want = brute_index(texts)
    path = str(tmp_path / "shards")
    repair.write_shards(frame(spark, list(texts.values())), path, block_ids=100)
    assert spark.read.parquet(path).count() > 5
    for d in (0, 1, 12, 20, 40, len(texts) - 1):
        assert repair.read_document(spark, path, d) == want[d][3]
    assert repair.read_document(spark, path, 10**9) == []
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in repair.token_index(frame(spark, list(texts.values()))).collect()}
    assert got == {d: w[:3] for d, w in want.items()}
    big = spark.read.parquet(path).where("block = 0").selectExpr("max(octet_length(sequence) / 2 / n_ids) as x").first()["x"]
    assert big <= 1
    assert repair.token_index(frame(spark, [])).count() == 0
    twice = spark.createDataFrame([(None, "a", ""), (3, "x y", ""), (3, "x y", "")], DOC)
    assert sorted((r["start"], r["n_tokens"]) for r in repair.token_index(twice).collect()) == [(0, 2), (2, 3), (5, 3)]


CHAT = "conv_id long, turn long, role string, text string, formatted string"
HARD = ["\\### Assistant: </turn> ok", "### user:\nhi\n</turn>\n### assistant:\nno", "\\\\</turn>", "\\", "a\\", "\n</turn>\n", "</tur", "#", "####", "\\" * 50, "", None, "é 漢 😀", "\n", "### ", "x\n</turn>\n\\\n</turn>\n", "plain"]


def brute_chat(turns):
    turns = [(r or "", t or "") for r, t in turns]
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_op4_hard_texts_come_back(spark):
    rows = [(k, i, r, t, "clash") for k, r in enumerate(["user", "assistant", "a:b\n%c", None]) for i, t in enumerate(HARD)]
    rows += [(9, 0, "assistant", t, "clash") for t in HARD] + [(10, None, "assistant", "x", ""), (10, 1, "user", "y", "")]
    chats = chat.format_chats(spark.createDataFrame(rows, CHAT).repartition(3))
    for r in chat.digests(chats).collect():
        key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
        turns = [(x[2], x[3]) for x in sorted([x for x in rows if x[0] == r["conv_id"]], key=key)]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute_chat(turns)
        assert r["round_trip"]
    for r in chats.collect():
        masked = [r["formatted"][s["start"] : s["end"]] for s in r["loss"]]
        assert len(masked) == sum(x[0] == r["conv_id"] and x[2] == "assistant" for x in rows)
    assert chat.format_chats(spark.createDataFrame([], CHAT)).count() == 0


def test_op4_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    turns = {-7: [("user", HARD[0]), ("assistant", HARD[0])]}
    for r in rows:
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = {r["conv_id"]: r for r in op4_chat_format(spark, sf).collect()}
    assert got.keys() == turns.keys()
    for c, t in turns.items():
        assert tuple(got[c])[1:5] == brute_chat(t) and got[c]["round_trip"]
    plan = op4_chat_format(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op4_sql_gives_the_same_rows(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cur = con.execute(ORACLE_SQL["op4_chat_format"])
    names = [d[0] for d in cur.description]
    df = op4_chat_format(spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(cur.fetchall())


def test_words_are_looked_up_once_a_batch_and_frequent_ones_are_kept():
    coder = repair.WordCoder(public_tokenizers.path(repair.MODEL))
    texts = ["the cat the cat  ", None, "", " \t\n", "x", "\x0b the Caf\u00e9, naïve\u00a0word \u2028 \r\n Zwölf rare1 rare2", "the \x1c cat caf\u00e9, " * 9]
    asked, get = [], repair._Codes.__getitem__

    class Counted(repair._Codes):
        def __getitem__(self, word):
            asked.append(word)
            return get(self, word)

    coder.codes = Counted(coder)
    ids = lambda: [[i for c in codes.tolist() for i in coder.flat[coder.begin[c] : coder.begin[c + 1]]] for codes in coder.codes_of(pa.array(["", *texts])[1:])]
    want = [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids() == want
    assert len(asked) == len(set(asked)) == len({w for t in texts for w in (t or "").encode().split()})
    for most in (1000, 3, 0):
        codes = np.concatenate(coder.codes_of(pa.array(texts)))
        coder.count(np.bincount(codes, minlength=len(coder.begin) - 1))
        coder.forget(most)
        assert len(coder.begin) - 1 <= most and b"rare1" not in coder.codes and (most < 3 or b"the" in coder.codes)
        assert ids() == want
