"""The image engine: unit values, invariants, and agreement of its two engines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaicore import params as P
from mosaicore.functions import pixels as px
from mosaicore.operators import batch, blocks, codec, features, kernels, metrics, overlay, search
from mosaicore.operators.transforms import apply, expanded, gather
from mosaicore.plans import sweep
from mosaicore.sources import codefile, imagefile, synthetic

EncodeParams = P.EncodeParams


def image(channels, h, w, seed=0):
    y, x = np.indices((h, w))
    base = 0.5 + 0.3 * np.sin(y / 5) * np.cos(x / 7)
    noise = np.random.default_rng(seed).random((channels, h, w)) * 0.3
    return np.clip(base[None] * np.linspace(0.7, 1, channels)[:, None, None] + noise - 0.15, 0, 1)


def pixels_of(spark, *images):
    out = None
    for k, im in enumerate(images):
        own = synthetic.from_array(spark, np.moveaxis(im, 0, 2), k)
        out = own if out is None else out.unionByName(own)
    return out.coalesce(2)


# ------------------------------------------------------------ parameters


def test_transform_lists():
    assert P.transform_list(None) == list(range(8)) and P.transform_list("all") == list(range(15))
    assert P.transform_list([3, 3, 1]) == [3, 1]
    for bad in ([], [15], [-1]):
        with pytest.raises(ValueError):
            P.transform_list(bad)


@pytest.mark.parametrize("bad", [{"block": 0}, {"max_block": 12}, {"max_block": 16, "min_block": 3, "use_quadtree": True}, {"backend": "x"}, {"topk": 0}, {"stride": 0}, {"s_clip": 0.0}, {"o_min": 2.0}, {"transform_ids": (99,)}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        EncodeParams(**bad).checked()


def test_derived_parameters():
    p = EncodeParams(min_block=4, max_block=16, use_s_sets=True, bucket_count=5).checked()
    assert (p.min_block, p.bucket_count, p.use_s_sets, p.levels) == (16, 1, False, [16])
    p = EncodeParams(min_block=4, max_block=16, use_quadtree=True, use_buckets=True, bucket_count=1).checked()
    assert (p.levels, p.bucket_count) == ([16, 8, 4], 2)
    assert all(x.checked() for x in P.PRESETS.values())


def test_option_getters():
    own = {"i": 3, "f": 2.0, "h": 2.5, "b": True, "z": 0, "s": "x", "n": None}
    assert P.pick_int(own, "i", 0) == 3 and P.pick_int(own, "f", 0) == 2 and P.pick_int(own, "q", 7) == 7 and P.pick_int(own, "q", 7, "i") == 3
    assert P.pick_float(own, "i", 0.0) == 3.0 and P.pick_bool(own, "z", True) is False and P.pick_str(own, "s", "") == "x" and P.pick_opt_int(own, "n") is None
    for f, key in ((P.pick_int, "h"), (P.pick_int, "b"), (P.pick_float, "b"), (P.pick_bool, "f"), (P.pick_bool, "i"), (P.pick_str, "i"), (P.pick_opt_int, "s")):
        with pytest.raises(ValueError):
            f(own, key, 0)


def test_null_options_are_defaults():
    own = {"i": None, "f": None, "b": None, "s": None}
    assert (P.pick_int(own, "i", 3), P.pick_float(own, "f", 0.5), P.pick_bool(own, "b", True), P.pick_str(own, "s", "x"), P.pick_opt_int(own, "i", 4)) == (3, 0.5, True, "x", 4)
    assert P.encode_params({"stride": None, "topk": 5, "buckets": None}) == EncodeParams(topk=5)


def test_pictures_of_a_case(tmp_path):
    found = sweep.pictures({"images": [{"path": "a/x.png", "channels": 1}, {"image": "y.png", "name": "why", "size": 64}]}, tmp_path)
    assert [(p.name, p.path, p.channels, p.size) for p in found] == [("img0", tmp_path.resolve() / "a/x.png", 1, None), ("why", tmp_path.resolve() / "y.png", 0, 64)]
    assert sweep.pictures({"image": "lena.png"}, tmp_path)[0].name == "lena" and sweep.pictures({"pattern": "smooth", "channels": 1, "seed": 4}) == [sweep.Picture("syn_smooth_1c", None, "smooth", 1, None, 4)]
    for bad in ({"images": [{"name": "x"}]}, {"images": "x.png"}, {"image": "x", "channels": 2}, {"pattern": "edges", "channels": 4}):
        with pytest.raises(ValueError):
            sweep.pictures(bad)
    assert sweep.decode_arguments({"decode": {"iters": 5}}) == {"iterations": 5} and sweep.decode_arguments({}) == {"iterations": 8}


def test_yaml(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text("encode:\n  quadtree: true\n  buckets: 8\n  stride: 2\n  max_domains: null\nother:\n")
    config = P.load_yaml(path)
    p = P.encode_params(P.get_section(config, "encode"), stride=6)
    assert p.use_quadtree and p.use_buckets and p.bucket_count == 8 and p.stride == 6 and p.max_domains is None
    assert P.get_section(config, "other") == {} == P.get_section(config, "none")
    path.write_text("- 1")
    with pytest.raises(ValueError):
        P.load_yaml(path)
    path.write_text("")
    assert P.load_yaml(path) == {}
    with pytest.raises(ValueError):
        P.get_section({"a": 1}, "a")


# ------------------------------------------------------------ transforms and features


def test_transforms_are_ten_maps():
    for b in (4, 8, 16):
        assert len({gather(b, t) for t in range(15)}) == 10
        assert gather(b, 8) == gather(b, 7) and gather(b, 9) == gather(b, 4) and gather(b, 10) == gather(b, 5) and gather(b, 11) == gather(b, 6) and gather(b, 13) == gather(b, 0)
    with pytest.raises(ValueError):
        gather(8, 15)


def test_isometries_form_a_group():
    b = np.arange(16.0).reshape(4, 4)
    images = {tuple(apply(b, t).ravel()): t for t in range(8)}
    assert all(tuple(apply(apply(b, s), t).ravel()) in images for s in range(8) for t in range(8))
    assert np.array_equal(apply(b, 1), np.rot90(b, -1)) and np.array_equal(apply(b, 7), b.T) and np.array_equal(apply(b, 4), b[:, ::-1]) and np.array_equal(apply(b, 5), np.rot90(b, 2).T)


def test_shear_shifts():
    b = np.ones((16, 16))
    assert [int((row == 0).sum()) for row in apply(b, 14)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 3, 4, 4]
    assert apply(b, 14)[15, 0] == 0 and apply(b, 12)[15, -1] == 0


def test_expanded(spark):
    a = np.arange(16.0).reshape(4, 4)
    rows = expanded(spark.createDataFrame([(1, a.ravel().tolist())], "id int, a array<double>"), 4, [0, 3, 12], "a").collect()
    assert [(r.tf_pos, r.tf) for r in rows] == [(0, 0), (1, 3), (2, 12)]
    assert all(np.array_equal(np.array(r.a).reshape(4, 4), apply(a, r.tf)) for r in rows)


@pytest.mark.parametrize(("values", "want"), [([0.0] * 256, 0.0), ([k / 255 for k in range(256)], 1.0), ([-0.1, 1.2] * 128, 0.125)])
def test_entropy(spark, values, want):
    assert abs(kernels.entropy(np.array([values]) + 1e-9)[0] - want) < 1e-6
    got = features.described(spark.createDataFrame([(1, [v + 1e-9 for v in values])], "id int, a array<double>")).first()
    assert abs(got.ent - want) < 1e-6 and abs(got["var"] - np.var(values)) < 1e-6


def test_gray_and_clamp(spark):
    rows = [(0, c, 0, x, 255.0 if c == x else 0.0) for c in range(3) for x in range(3)]
    got = sorted(blocks.gray_u8(spark.createDataFrame(rows, "image_id long, ch int, y int, x int, v double")).collect())
    assert [r.g for r in got] == [76, 149, 29]
    clamped = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 2.0)], "v double").select(px.clamp_u8(F.col("v")).alias("u")).collect()
    assert [r.u for r in clamped] == [0, 0, 127, 255, 255]


def test_quantiser_round_trip():
    s = np.linspace(-1.2, 1.2, 301)
    q = kernels.quantise(s, -0.99, 0.99)
    assert np.abs(q * 1.98 / 255 - 0.99 - np.clip(s, -0.99, 0.99)).max() <= 0.5 * 1.98 / 255 + 1e-12 and q.min() == 0 and q.max() == 255


def test_snap_and_sets():
    sets = px.s_sets(8, 0.99)
    assert len(sets) == 8 and [len(s) for s in sets] == [5] * 4 + [7] * 4 and sets[0][-1] == pytest.approx(0.2) and sets[7][-1] == pytest.approx(0.99) and sets[7][0] < 0
    assert px.s_sets(1, 0.99)[0][-1] == pytest.approx(0.2)


def test_normalised_rows():
    a = np.random.default_rng(0).random((5, 16))
    z = kernels.normalise_rows(np.vstack([a, np.full((1, 16), 0.3)]))
    assert np.allclose(z.sum(axis=1), 0, atol=1e-9) and np.allclose((z[:5] ** 2).sum(axis=1), 1) and np.allclose(z[5], 0)


# ------------------------------------------------------------ grids


def test_padding_and_grids(spark):
    im = image(3, 5, 7)
    padded = blocks.pad_to_multiple(pixels_of(spark, im), 4)
    got = np.zeros((3, 8, 8))
    for r in padded.collect():
        got[r.ch, r.y, r.x] = r.v
    assert padded.count() == 192 and np.array_equal(got, kernels.pad(im, 4))


@pytest.mark.parametrize("stride", [2, 3, 4])
def test_domains_match_windows(spark, stride):
    im = image(1, 24, 20)
    want, yx = kernels.windows(im, 4, stride)
    rows = sorted(blocks.domains(pixels_of(spark, im), 4, stride).collect(), key=lambda r: r.dom)
    assert [(r.y, r.x) for r in rows] == [tuple(p) for p in yx.tolist()] and np.allclose([r.a for r in rows], want[0])
    grid = sorted(blocks.domain_grid(spark.createDataFrame([(0, 24, 20)], "image_id long, height int, width int"), 4, stride).collect())
    assert [(r.idx, r.y, r.x) for r in grid] == [(r.dom, r.y, r.x) for r in rows]


# ------------------------------------------------------------ the two engines

CASES = {
    "dot": EncodeParams(block=4, stride=4, topk=6),
    "odd_stride_all": EncodeParams(block=8, stride=5, topk=8, transform_ids="all"),
    "quantized": EncodeParams(block=8, stride=2, topk=5, quantized=True),
    "buckets": EncodeParams(block=4, stride=4, topk=6, use_buckets=True, bucket_count=8, use_s_sets=True),
    "lsh": EncodeParams(block=4, stride=4, topk=6, backend="lsh", lsh_planes=8, lsh_budget=40),
    "lsh_buckets": EncodeParams(block=4, stride=4, topk=6, backend="lsh", lsh_planes=10, lsh_budget=16, use_buckets=True, bucket_count=4),
    "quadtree": EncodeParams(min_block=4, max_block=16, stride=4, topk=12, use_quadtree=True, max_mse=0.004),
    "entropy": EncodeParams(block=4, stride=4, topk=6, entropy_thresh=0.43),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_engines_agree(spark, name):
    p = CASES[name]
    images = [image(1, 32, 32, 1), image(3, 35, 40, 2)]
    pixels = pixels_of(spark, *images)
    got = sorted(codec.leaf_order(codec.encode(pixels, p), p.checked().max_block).collect(), key=lambda r: (r.image_id, r.leaf_id))
    at = 0
    for k, im in enumerate(images):
        code = kernels.encode(im, p)
        values = code.values()
        for i in range(len(code.leaf_yx)):
            r = got[at]
            at += 1
            assert (r.image_id, r.leaf_id, r.y, r.x, r.block) == (k, i, *code.leaf_yx[i], code.pool_blocks[code.leaf_pool[i]])
            assert (r.dom, r.tf) == (code.leaf_dom[i], code.leaf_tf[i]) or abs(r.mse - code.leaf_mse[i]) < 1e-9
            assert r.mse == code.leaf_mse[i] or abs(r.mse - code.leaf_mse[i]) < 1e-9
            if (r.dom, r.tf) == (code.leaf_dom[i], code.leaf_tf[i]):
                assert np.allclose([(c.s, c.o) for c in r.codes], values[i], atol=1e-6)
    assert at == len(got)


def test_decoders_agree(spark):
    im = image(3, 32, 40)  # no padding: repeated edges make ties that the engines may break differently
    p = EncodeParams(min_block=4, max_block=8, stride=4, topk=8, use_quadtree=True, max_mse=0.004, transform_ids="all")
    pixels = pixels_of(spark, im)
    leaves = codec.encode(pixels, p).cache()
    code = kernels.encode(im, p)
    code.codes = code.codes.astype(float)
    for n in (0, 1, 3):
        got = np.zeros(im.shape)
        for r in codec.decode(leaves, codec.image_table(pixels, 8), 4, n).collect():
            got[r.ch, r.y, r.x] = r.v
        assert np.allclose(got, kernels.decode(code, n), atol=1e-5)


@pytest.mark.parametrize("preset", sorted(P.PRESETS))
@pytest.mark.parametrize("channels", [1, 3])
def test_presets(preset, channels):
    im = image(channels, 50, 64)
    code = kernels.encode(im, P.PRESETS[preset])
    out = kernels.decode(code, 10)
    assert out.shape == im.shape and np.isfinite(out).all() and kernels.mse(im, out) < 0.45


def test_smooth_image_quality():
    y, x = np.indices((128, 128))
    im = (0.6 * y / 127 + 0.4 * x / 127)[None]
    code = kernels.encode(im, EncodeParams(block=16, stride=8, topk=32, max_domains=3000))
    assert kernels.psnr(im, kernels.decode(code)) > 40 and len(codefile.dump(code)) == 1884
    assert kernels.psnr(im, im) == 99.0


def test_leaves_tile_the_image():
    code = kernels.encode(image(1, 64, 64), EncodeParams(min_block=4, max_block=16, use_quadtree=True, max_mse=0.006))
    seen = np.zeros((64, 64), int)
    for (y, x), k in zip(code.leaf_yx, code.leaf_pool):
        b = code.pool_blocks[k]
        seen[y : y + b, x : x + b] += 1
    assert (seen == 1).all() and len(set(code.leaf_pool.tolist())) > 1


def test_empty_pools():
    with pytest.raises(ValueError, match="domain pool empty"):
        kernels.encode(image(1, 16, 16), EncodeParams(block=16))
    with pytest.raises(ValueError, match="domain pool empty"):
        kernels.encode(np.zeros((1, 32, 32)), EncodeParams(block=8, entropy_thresh=0.5))
    with pytest.raises(ValueError):
        kernels.encode(np.zeros((2, 32, 32)), EncodeParams(block=8))


@pytest.mark.parametrize("backend", ["dot", "lsh"])
def test_empty_pools_of_the_declarative_engine(spark, backend):
    for im, p in ((image(1, 16, 16), EncodeParams(block=16, backend=backend)), (np.zeros((1, 32, 32)), EncodeParams(block=8, entropy_thresh=0.5, backend=backend))):
        with pytest.raises(Exception, match="domain pool empty"):
            codec.encode(pixels_of(spark, im), p).collect()


@pytest.mark.parametrize("stride, more", [(5, {}), (4, {"entropy_thresh": 0.43}), (3, {"max_domains": 9, "transform_ids": "all"})])
def test_decoding_of_odd_strides_and_chosen_domains(spark, stride, more):
    """The declarative decoder reads a leaf's domain where it lies; the reference decodes leaf by leaf."""
    im = image(1, 32, 40)
    p = EncodeParams(block=4, stride=stride, topk=6, **more)
    pixels = pixels_of(spark, im)
    leaves = codec.encode(pixels, p).cache()
    rows = leaves.collect()
    want = np.zeros((32, 40))
    for _ in range(2):
        small = np.zeros((32, 40))
        for r in rows:
            part = want[r.dy : r.dy + 8, r.dx : r.dx + 8].reshape(4, 2, 4, 2).mean(axis=(1, 3))
            small[r.y : r.y + 4, r.x : r.x + 4] = np.clip(r.codes[0].s * apply(part, r.tf) + r.codes[0].o, 0, 1)
        want = small
    got = np.zeros((32, 40))
    for r in codec.decode(leaves, codec.image_table(pixels, 4), stride, 2).collect():
        got[r.y, r.x] = r.v
    assert np.allclose(got, want, atol=1e-9)
    if not more:
        assert len({(r.dy, r.dx) for r in rows}) > 3


def test_projected_search_of_the_declarative_engine(spark):
    im = image(1, 32, 32, 5)
    p = EncodeParams(block=4, stride=4, topk=6, backend="pca_lsh", pca_dim=6, lsh_planes=4, lsh_budget=12, transform_ids=(0,))  # with the isometries directions are not unique
    got = sorted(codec.leaf_order(codec.encode(pixels_of(spark, im), p), 4).collect(), key=lambda r: r.leaf_id)
    code = kernels.encode(im, p)
    assert len(got) == len(code.leaf_yx) and np.mean([abs(r.mse - m) < 1e-9 for r, m in zip(got, code.leaf_mse)]) > 0.9


def test_best_pairs():
    rng = np.random.default_rng(1)
    q, pool = rng.standard_normal((30, 9)), rng.standard_normal((50, 9))
    pool[20:30] = pool[3]  # ties go to the lower entry
    qb, pb = rng.integers(0, 3, 30), rng.integers(0, 3, 50)
    for buckets in (False, True):
        row, entry, score, rank = search.best_pairs(q, pool, 7, qb if buckets else None, pb if buckets else None)
        for k in range(30):
            exact = [sum(a * b for a, b in zip(q[k], p)) for p in pool]
            own = sorted((i for i in range(50) if not buckets or pb[i] == qb[k]), key=lambda i: (-exact[i], i))[:7]
            assert entry[row == k].tolist() == own and rank[row == k].tolist() == list(range(1, len(own) + 1))


def test_full_search_is_brute_force():
    im = image(1, 32, 32)
    all_ = kernels.encode(im, EncodeParams(block=8, stride=4, topk=10_000))
    few = kernels.encode(im, EncodeParams(block=8, stride=4, topk=4))
    pool = kernels.Pool(im, EncodeParams(block=8, stride=4).checked(), 8)
    for i, (y, x) in enumerate(all_.leaf_yx):
        r = im[0, y : y + 8, x : x + 8].ravel()
        best = math.inf
        for d in pool.chans[0]:
            s, o = np.polyfit(d, r, 1)
            s, o = np.clip(s, -0.99, 0.99), None
            sl, ol = np.polyfit(d, r, 1)
            best = min(best, ((r - s * d - np.clip(ol, -0.5, 1.5)) ** 2).mean())
        assert abs(best - all_.leaf_mse[i]) < 1e-9
    assert (few.leaf_mse >= all_.leaf_mse - 1e-12).all()


def test_pca():
    x = np.random.default_rng(0).random((300, 20))
    mean, basis = search.fit_pca(x, 5, 0)
    assert np.allclose(basis @ basis.T, np.eye(5)) and np.allclose(mean, x.mean(axis=0))
    assert np.array_equal(search.fit_pca(x, 20, 0)[1], np.eye(20))
    sample = search.fit_pca(np.vstack([x] * 30), 5, 0, sample=1000)
    assert sample[1].shape == (5, 20)


# ------------------------------------------------------------ files


def test_code_files(spark, tmp_path):
    codefile.register(spark)
    codes = [kernels.encode(image(c, 40, 32, c), EncodeParams(block=8, quantized=q)) for c in (1, 3) for q in (False, True)]
    data = [codefile.dump(c) for c in codes]
    for code, raw in zip(codes, data):
        assert len(raw) == codefile.size_of(1, len(code.domain_yx), len(code.leaf_yx), code.channels, code.quantized)
        assert codefile.dump(codefile.load(raw + b"more")) == raw
        for cut in (10, 43, 60, len(raw) - 1):
            with pytest.raises(ValueError, match="truncated"):
                codefile.load(raw[:cut])
        with pytest.raises(ValueError, match="bad magic"):
            codefile.load(b"XXXX" + raw[4:])
    rows = spark.createDataFrame([(f"im{k}", bytearray(raw)) for k, raw in enumerate(data)], "name string, code binary")
    rows.write.format("ffc2").mode("append").save(str(tmp_path / "codes"))
    for back in (spark.read.format("ffc2").load(str(tmp_path / "codes")), codefile.read_codes(spark, str(tmp_path / "codes"))):
        assert [bytes(r.code) for r in back.orderBy("name").collect()] == data
    broken = codes[0]
    broken.leaf_dom = broken.leaf_dom + (1 << 33)
    with pytest.raises(OverflowError):
        codefile.dump(broken)


def test_images_and_png(spark, tmp_path):
    codefile.register(spark)
    im = np.round(image(3, 20, 30) * 255)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(imagefile.png(im))
    (tmp_path / "in" / "b.png").write_bytes(imagefile.png(im[:1]))
    rows = {r.name[-5:]: r for r in imagefile.read_images(spark, str(tmp_path / "in")).collect()}
    assert np.allclose(np.array(rows["a.png"].data).reshape(3, 20, 30), im / 255) and np.allclose(np.array(rows["b.png"].data).reshape(1, 20, 30), im[:1] / 255)
    small = imagefile.read_images(spark, str(tmp_path / "in"), mode="L", max_side=15).collect()
    assert {(r.channels, r.height, r.width) for r in small} == {(1, 10, 15)}
    assert imagefile.fitted(3000, 10, 2048) == (2048, 7) and imagefile.fitted(10, 1, None) == (10, 1)
    with pytest.raises(ValueError):
        imagefile.png(np.zeros((2, 4, 4)))
    with pytest.raises(ValueError):
        imagefile.read_images(spark, "x", mode="CMYK")


def test_resize_keeps_constants():
    assert np.allclose(imagefile.resize(np.full((1, 9, 14), 0.3), 4, 5), 0.3)


def test_command_line(spark, tmp_path):
    from mosaicore.__main__ import main

    source = tmp_path / "in"
    source.mkdir()
    (source / "x.png").write_bytes(imagefile.png(np.round(image(3, 32, 48) * 255)))
    (tmp_path / "c.yml").write_text("encode:\n  topk: 8\n  stride: 8\n")
    assert main(["encode", str(source), str(tmp_path / "codes"), "--config", str(tmp_path / "c.yml"), "--block", "8", "--quantized", "true"]) == 0
    code = codefile.load((tmp_path / "codes" / "x.ffc").read_bytes())
    assert code.quantized and code.pool_blocks.tolist() == [8] and code.pool_strides.tolist() == [8]
    assert main(["decode", str(tmp_path / "codes"), str(tmp_path / "out"), "--iters", "6"]) == 0
    assert main(["overlay", str(tmp_path / "codes"), str(tmp_path / "out"), "--upscale", "2"]) == 0
    shapes = {r.name[-12:]: (r.channels, r.height, r.width) for r in imagefile.read_images(spark, str(tmp_path / "out")).collect()}
    assert sorted(shapes.values()) == [(1, 64, 96), (3, 32, 48)]
    assert main(["process", str(source), str(tmp_path / "small"), "--mode", "L", "--width", "8", "--height", "6"]) == 0
    assert [(r.channels, r.height, r.width) for r in imagefile.read_images(spark, str(tmp_path / "small")).collect()] == [(1, 6, 8)]


def test_folders_within_folders(spark, tmp_path):
    from mosaicore.__main__ import main

    source = tmp_path / "in"
    for k, part in enumerate(("a", "b/c")):
        (source / part).mkdir(parents=True)
        (source / part / "1.x.png").write_bytes(imagefile.png(np.round(image(1, 32, 32, k) * 255)))
    assert main(["encode", str(source), str(tmp_path / "codes"), "--block", "8", "--iterations-hint", "3"]) == 0
    found = sorted(str(p.relative_to(tmp_path / "codes")) for p in (tmp_path / "codes").rglob("*.ffc"))
    assert found == ["a/1.x.ffc", "b/c/1.x.ffc"]
    codefile.register(spark)
    names = [sorted(r.name for r in x.collect()) for x in (spark.read.format("ffc2").load(str(tmp_path / "codes")), codefile.read_codes(spark, str(tmp_path / "codes")))]
    assert names == [["a/1.x", "b/c/1.x"]] * 2
    code = codefile.load((tmp_path / "codes" / "a" / "1.x.ffc").read_bytes())
    for iters, n in ((["--iters", "0"], 0), ([], 3)):
        assert main(["decode", str(tmp_path / "codes"), str(tmp_path / f"out{n}"), *iters]) == 0
        assert (tmp_path / f"out{n}" / "a" / "1.x.png").read_bytes() == imagefile.png(imagefile.save_bytes(kernels.decode(code, n)))
    assert main(["overlay", str(tmp_path / "codes"), str(tmp_path / "lines"), "--background", "black", "--line-value", "200", "--thickness", "2", "--alpha", "0.5"]) == 0
    rows = imagefile.read_images(spark, str(tmp_path / "lines")).collect()
    assert len(rows) == 2 and set(np.round(np.array(rows[0].data) * 255)) == {0, 100}


def test_files_that_are_no_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(imagefile.png(np.zeros((1, 4, 4))))
    (tmp_path / "b.png").write_bytes(b"no image")
    assert imagefile.read_images(spark, str(tmp_path), invalid="drop").count() == 1
    with pytest.raises(Exception, match="cannot read .*b.png"):
        imagefile.read_images(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        imagefile.read_images(spark, str(tmp_path), invalid="skip")


def test_streaming(spark, tmp_path):
    from mosaicore.streaming.landing import encode_arrivals

    planes = batch.to_planes(pixels_of(spark, image(1, 32, 32), image(1, 32, 40)))
    planes.write.parquet(str(tmp_path / "land"))
    args = (spark, str(tmp_path / "land"), str(tmp_path / "codes"), str(tmp_path / "check"), EncodeParams(block=8, topk=4), imagefile.PLANES)
    encode_arrivals(*args).awaitTermination(60)
    planes.limit(1).write.mode("append").parquet(str(tmp_path / "land"))
    encode_arrivals(*args).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "codes")).count() == 3


def test_batch_round_trip(spark):
    pixels = pixels_of(spark, image(1, 32, 40), image(3, 33, 47))
    planes = batch.to_planes(pixels)
    assert sorted(batch.to_pixels(planes).collect()) == sorted(pixels.collect())
    p = EncodeParams(block=4, stride=2, topk=16)
    codes = batch.encode(planes, p)
    out = metrics.quality(pixels, batch.to_pixels(batch.decode(codes, 10))).collect()
    assert len(out) == 2 and all(r.mse < 0.03 and r.psnr > 15 for r in out)
    assert batch.leaves(codes).count() == 80 + 9 * 12
    with pytest.raises(ValueError):
        batch.encode(planes, EncodeParams(max_block=12))


# ------------------------------------------------------------ overlay and sweeps


def leaf_rows(spark):
    return spark.createDataFrame([(0, y, x, 2) for y in (0, 2) for x in (0, 2)], "image_id long, y int, x int, block int"), spark.createDataFrame([(0, 4, 4, 4, 4)], "image_id long, height int, width int, orig_height int, orig_width int")


def test_edge_mask(spark):
    leaves, images = leaf_rows(spark)
    mask = {(r.y, r.x) for r in overlay.edge_mask(leaves, images).collect()}
    assert mask == {(y, x) for y in range(4) for x in range(4) if y in (0, 2) or x in (0, 2)}
    assert mask < {(r.y, r.x) for r in overlay.edge_mask(leaves, images, 2).collect()}


def test_overlay(spark):
    leaves, images = leaf_rows(spark)
    got = {(r.y, r.x): r.g for r in overlay.outlined(None, leaves, images, background="black", line_value=200).collect()}
    assert len(got) == 16 and got[0, 0] == 200 and got[1, 1] == 0
    big = overlay.outlined(None, leaves, images, background="black", line_value=300, alpha=0.5, upscale=3).collect()
    assert len(big) == 144 and {r.g for r in big} == {0, 127}
    with pytest.raises(ValueError):
        overlay.outlined(None, leaves, images, background="white")


def test_sweeps(spark):
    assert sweep.values({"start": 1, "stop": 2, "step": 0.5}) == [1.0, 1.5, 2.0] and sweep.values({"start": 4, "stop": 0, "step": -2}) == [4, 2, 0]
    assert sweep.values({"a": 1}) == [{"a": 1}] and sweep.values("x") == ["x"]
    with pytest.raises(ValueError):
        sweep.range_values(0, 1, 0)
    rows = sweep.grid(spark, {"b": [1, 2], "a": ["x", "y"]}).orderBy("point").collect()
    assert [(r.a, r.b) for r in rows] == [(d["a"], d["b"]) for d in sweep.settings({"b": [1, 2], "a": ["x", "y"]})] and rows[1].name == "a=x__b=2"
    cases = sweep.cases({"stride": 8}, {"topk": [4, 8], "backend": ["dot", "lsh"]}, max_items=3)
    assert [n for n, _ in cases] == ["backend=dot__topk=4", "backend=dot__topk=8", "backend=lsh__topk=4"] and cases[2][1].stride == 8
    names = [n for n, _ in cases]
    assert sweep.selected(names, prefix="backend=dot") == names[:2] and sweep.selected(names, span="1:") == names[1:] and sweep.selected(names, case="x") == []


def test_synthetic(spark):
    for make in (synthetic.smooth, synthetic.edges):
        rows = make(spark, 32, 3).collect()
        assert len(rows) == 3 * 32 * 32 and 0 <= min(r.v for r in rows) and max(r.v for r in rows) <= 1
    assert synthetic.random_image(8, 3, 123).shape == (8, 8, 3) and np.array_equal(synthetic.random_image(8, 1, 5), synthetic.random_image(8, 1, 5))
