"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from lontar.llm import chaining, chat, multi_index, packing, simhash, transport


@given(st.text(alphabet=st.sampled_from("\\<|>n\nimé_ ")))
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_transport_round_trip(data):
    assert transport.from_transport(transport.to_transport(transport.padded(data)))[0].rstrip(b"\0") == data.rstrip(b"\0")


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=12))
def test_packing_covers(histogram):
    held = {}
    for pattern, times in packing.solve(histogram, 64):
        assert times > 0 and sum(k * n for k, n in pattern.items()) <= 64
        for k, n in pattern.items():
            held[k] = held.get(k, 0) + n * times
    assert held == histogram


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=80, unique=True), st.integers(0, 6))
def test_linked_pairs(codes, distance):
    codes = codes + [c ^ 5 for c in codes[:10]]
    x = np.array(sorted(set(codes)), np.uint64)
    x = x[np.argsort(simhash.gray_rank(x))]
    found = {(int(a), int(b)) for p, q in simhash.linked_pairs(x, distance) for a, b in zip(p, q, strict=True)}
    assert found == {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if (int(x[a]) ^ int(x[b])).bit_count() <= distance}


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


def test_top_masks_meet():
    rng = np.random.default_rng(2)
    for j in (1, 2, 3):
        masks = simhash.top_masks(4, j)
        for _ in range(200):
            a = int(rng.integers(1 << 63))
            b = a ^ sum(1 << int(k) for k in rng.choice(64, 4, replace=False))
            assert any((a ^ b) & m == 0 for m in masks)


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(3)
    books = (rng.standard_normal((6, 3)), rng.standard_normal((5, 3)))
    x = rng.standard_normal((40, 6))
    got = multi_index.visits(x, books, 7)
    d = ((x[:, None, :3] - books[0]) ** 2).sum(2)[:, :, None] + ((x[:, None, 3:] - books[1]) ** 2).sum(2)[:, None, :]
    for row, cost in zip(got, d.reshape(40, -1), strict=True):
        assert np.allclose(np.sort(cost)[:7], cost[row])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 200)), min_size=1, max_size=60, unique=True))
def test_chains_are_collinear(matches):
    x, y = (np.array(v) for v in zip(*sorted(matches), strict=True))
    for chain in chaining.chains(x, y):
        for (a, b, n), (c, d, _) in zip(chain, chain[1:], strict=False):
            assert a + n <= c and b + n <= d


def test_closer_takes_words_said_often(monkeypatch):
    """A passage all of whose K-mers stand over MOST times in both sides, with a word more in one; listed or by diagonals."""
    import numpy as np

    from lontar.llm import chaining as C

    rng = np.random.default_rng(4)
    unit = rng.integers(0, 1 << 16, 6).astype("<u2")
    core = np.tile(unit, 30)
    ends = [rng.integers(0, 1 << 16, 40).astype("<u2") for _ in range(4)]
    wx = np.concatenate([ends[0], core, ends[1]])
    wy = np.concatenate([ends[2], core[:90], ends[3][:1], core[90:], ends[3]])
    found = C.closer(wx, wy)
    assert max(min(x1 - x0, y1 - y0) for x0, x1, y0, y1 in found) >= 180
    monkeypatch.setattr(C, "MATCHES", 10)
    assert sorted(C.closer(wx, wy)) == sorted(found)
    assert not C.closer(wx, np.concatenate(ends))
