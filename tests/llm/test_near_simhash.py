"""The pipeline's near stage names pairs within the radius by SimHash, and by MinHash bands only those beyond it."""

import random

import numpy as np
import pyarrow as pa

from tallyforge.llm import near_dedup as nd
from tallyforge.llm.simhash_dedup import fingerprint, table_masks


def bucket(texts, t):
    """All texts as one bucket of table t; sketches agree wholly, keys nowhere."""
    m, zero = len(texts), np.zeros(len(texts), np.int32)
    fp = np.array([fingerprint(x, nd.WIDTH) for x in texts], np.uint64).view(np.int64)
    n = np.array([len(nd.shingles(x.encode())) for x in texts], np.int32)
    keys = [[i * nd.BANDS + k for k in range(nd.BANDS)] for i in range(m)]
    return pa.table({"key": np.ones(m, np.int64), "_lo": zero, "_hi": zero, "_chunk": zero, "t": zero + t, "rep": np.arange(m), "n": n, "fp": fp, "keys": pa.array(keys, pa.list_(pa.int64())), "sketch": [b"same"] * m})


def test_simhash_names_near_copies():
    rng, masks = random.Random(5), table_masks(5, nd.RADIUS)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(400)] for _ in range(40)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:-1], "end"]) for w in base]
    fps = [fingerprint(x, nd.WIDTH) for x in texts]
    near = {(i, j) for i in range(80) for j in range(i + 1, 80) if (fps[i] ^ fps[j]).bit_count() <= nd.RADIUS}
    assert 30 < len(near) < 60
    pairs = lambda b: {(i, int(j)) for i in range(b.m) for j in b.candidates(i)[0]}
    first = [(i, j) for i, j in near if not (fps[i] ^ fps[j]) & masks[0]]
    tables = [pairs(nd._Bucket(bucket(texts, t), masks)) for t in range(-len(masks), 0)]
    # one bucket holds all here, so a table names each near pair that no earlier table's bits bring together
    assert tables[0] == near and tables[1] == near - set(first)
    assert not near & pairs(nd._Bucket(bucket(texts, 0), masks))
    assert nd._live(bucket(texts, -len(masks)), masks).num_rows == len({i for p in near for i in p})
