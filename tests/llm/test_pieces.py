import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from framewise.llm.pieces import LITERAL, MODEL, SPACE, Encoder, PieceModel, decode_documents, encode_documents
from tests.llm.common import edges

P = PieceModel.load()
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def best_path(text: str) -> list[int]:
    """One text, one character at a time, from a dictionary of pieces."""
    if not text:
        return []
    pieces = {SP.id_to_piece(i): i for i in range(SP.vocab_size()) if not (SP.is_byte(i) or SP.is_control(i) or SP.is_unknown(i))}
    marked = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)
    best, back = [0.0], [0]
    for end in range(1, len(marked) + 1):
        top = (-np.inf, 0)
        for size in range(min(end, 16), 0, -1):
            i = pieces.get(marked[end - size : end])
            if i is not None or size == 1:
                total = best[end - size] + (P.scores[i] if i is not None else P.unknown)
                if total > top[0] + 1e-9:
                    top = (total, size)
        best.append(top[0])
        back.append(top[1])
    out, end = [], len(marked)
    while end:
        s = marked[end - back[end] : end]
        out = ([pieces[s]] if s in pieces else [SP.piece_to_id(f"<0x{b:02X}>") for b in (SPACE if s == LITERAL else s).encode()]) + out
        end -= back[end]
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="the an ou\n▁ é日", max_size=80))
def test_round_trip(text):
    ids, n = Encoder(P).encode([text, None, text])
    assert n[1] == 0 and n[0] == n[2] and P.decode(ids[: n[0]].tolist()) == text


def test_best_paths_of_one_batch():
    texts = ["Hello world", "the quick brown fox", " two  spaces ", "unbelievable internationalization", "日本 é\n\ttab", "thndwhst ouenaux", "aaaa" * 40, "x" * 100, ""]
    ids, n = Encoder(P).encode(texts)
    for t, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        want = best_path(t)
        score = lambda x: sum(P.scores[i] for i in x)
        assert own.tolist() == want or abs(score(own.tolist()) - score(want)) < 1e-6


def test_tables_round_trip(spark):
    docs = edges(spark).select("doc_id", "text").where("text is not null")
    back = decode_documents(encode_documents(docs))
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
