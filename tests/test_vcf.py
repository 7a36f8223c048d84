"""Goldens of view, concat and merge on small files, and files of every kind read back."""

import gzip
import random

import pytest

from locusframe.functions import exprs as X
from locusframe.header import VcfError, VcfHeader, attr, union
from locusframe.operators.concat import concat
from locusframe.operators.merge import MergeOptions, merge, merged_info, parse_rules, reindexed, rendered, renumbered
from locusframe.operators.regions import END, Regions, coalesced
from locusframe.operators.view import ViewOptions, view
from locusframe.sources import bgzf
from locusframe.sources.reader import read_vcf
from locusframe.sources.writer import concat_bytes, write_vcf

META = """##fileformat=VCFv4.2
##FILTER=<ID=PASS,Description="All filters passed">
##FILTER=<ID=LowQual,Description="Low">
##FILTER=<ID=q10,Description="Below, 10">
##contig=<ID=chr1,length=1000>
##INFO=<ID=AC,Number=A,Type=Integer,Description="x">
##INFO=<ID=AN,Number=1,Type=Integer,Description="x">
##INFO=<ID=DP,Number=1,Type=Integer,Description="x">
##INFO=<ID=EFF,Number=A,Type=String,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">
"""
HEAD = "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT "
X1 = META + '##INFO=<ID=SOMATIC,Number=0,Type=Flag,Description="x">\n' + """#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT X1 X2
chr1 100 . A G 50 PASS AC=1;AN=4;DP=10;EFF=mis GT:AD 0/1:5,6 0/0:9,1
chr1 200 rsA C T,G 60 PASS AC=1,1;AN=4;DP=20;EFF=a,b GT:AD 1/2:1,2,3 0/0:8,1,1
chr1 300 . G GT 70 q10 AC=2;AN=4;DP=30;SOMATIC GT:AD 1|1:0,7 0/0:6,0
chr1 500 . A AT 70 PASS AC=2;AN=4;DP=30 GT:AD 1/1:0,7 0/0:6,0
"""
X2 = META + '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="x">\n' + """#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT Y1
chr1 100 rsB A T 80 PASS AC=2;AN=2;DP=7;EFF=syn GT:AD:DP 1/1:0,9:9
chr1 200 . C G 90 LowQual AC=1;AN=2;DP=8;EFF=z GT:AD:DP 0/1:4,4:8
chr1 400 . T A 10 PASS AC=0;AN=2;DP=9;EFF=nc GT:AD:DP 0/0:9,0:9
chr1 500 . A G 70 PASS AC=1;AN=2;DP=5;EFF=q GT:AD:DP 0/1:3,3:6
"""
AT100 = "chr1 100 rsB A G,T 80 PASS DP=17;EFF=mis,syn;AN=6;AC=1,2 GT:AD:DP 0/1:5,6,.:. 0/0:9,1,.:. 2/2:0,.,9:9"
APART100 = ["chr1 100 . A G 50 PASS DP=10;EFF=mis;AN=4;AC=1 GT:AD 0/1:5,6 0/0:9,1 ./.:.", "chr1 100 rsB A T 80 PASS DP=7;EFF=syn;AN=2;AC=2 GT:AD:DP ./.:.:. ./.:.:. 1/1:0,9:9"]
MIDDLE = [
    "chr1 200 rsA C T,G 90 LowQual DP=28;EFF=a,b;AN=6;AC=1,2 GT:AD:DP 1/2:1,2,3:. 0/0:8,1,1:. 0/2:4,.,4:8",
    "chr1 300 . G GT 70 q10 DP=30;SOMATIC;AN=4;AC=2 GT:AD 1|1:0,7 0/0:6,0 ./.:.",
    "chr1 400 . T A 10 PASS DP=9;EFF=nc;AN=2;AC=0 GT:AD:DP ./.:.:. ./.:.:. 0/0:9,0:9",
]
SNP500 = "chr1 500 . A G 70 PASS DP=5;EFF=q;AN=2;AC=1 GT:AD:DP ./.:.:. ./.:.:. 0/1:3,3:6"
INDEL500 = "chr1 500 . A AT 70 PASS DP=30;AN=4;AC=2 GT:AD 1/1:0,7 0/0:6,0 ./.:."
ALL500 = "chr1 500 . A AT,G 70 PASS DP=35;EFF=.,q;AN=6;AC=2,1 GT:AD:DP 1/1:0,7,.:. 0/0:6,0,.:. 0/2:3,.,3:6"


def tabs(text):
    return "".join((x if x.startswith("##") else x.replace(" ", "\t")) + "\n" for x in text.splitlines())


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("vcf")
    for name, text in (("x1", X1), ("x2", X2)):
        (d / f"{name}.vcf").write_text(tabs(text))
    return d


def body(frame):
    return [r["value"].replace("\t", " ") for r in frame.lines().orderBy(*frame.order).collect()]


def load(spark, text, tmp_path, name="a.vcf"):
    (tmp_path / name).write_text(tabs(text))
    return read_vcf(spark, str(tmp_path / name))


@pytest.mark.parametrize(
    ("mode", "expected"),
    [
        ("both", [AT100, *MIDDLE, SNP500, INDEL500]), ("snps", [AT100, *MIDDLE, SNP500, INDEL500]), ("none", [*APART100, *MIDDLE, SNP500, INDEL500]),
        ("indels", [*APART100, *MIDDLE, INDEL500, SNP500]), ("all", [AT100, *MIDDLE, ALL500]),
    ],
)
def test_merge_modes(spark, files, mode, expected):
    frames = [read_vcf(spark, str(files / f"{x}.vcf")) for x in ("x1", "x2")]
    assert body(merge(frames, MergeOptions(mode))) == expected


def test_merge_declared_counts_and_paths(spark, tmp_path):
    record = "chr1 100 . A G . PASS DP=7 GT 0|1"
    for declared in (True, False):
        head = META if declared else "".join(x + "\n" for x in META.splitlines() if "ID=AC" not in x and "ID=AN" not in x)
        frames = [load(spark, head + HEAD + s + "\n" + record + "\n", tmp_path, f"{s}{declared}.vcf") for s in ("M1", "N1")]
        for general in (False, True):
            got = body(merge(frames, force_general=general))
            assert got == [f"chr1 100 . A G . PASS {'DP=14;AN=4;AC=2' if declared else 'DP=14'} GT 0|1 0|1"]


def test_uniform_and_general_paths_agree(spark, tmp_path):
    rng = random.Random(3)
    frames = []
    for f, n in enumerate((2, 3, 1)):
        rows = []
        for p in range(10, 400, 10):
            if rng.random() < 0.7:
                for _ in range(rng.choice([1, 1, 2])):
                    alt, fmt = rng.choice(["G", "G", "T", "G,T", "GA", "."]), rng.choice(["GT:DP", "GT:DP", "GT:AD:DP"])
                    cols = [":".join([rng.choice(["0/1", "1|1", "./.", "0", "0/0/1"]), *(["3,4"] if "AD" in fmt else []), "7"]) for _ in range(n)]
                    rows.append(f"chr1 {p} {rng.choice(['.', 'r1', 'r2;r1'])} A {alt} {rng.choice(['.', '5', '7.50', '1e2'])} {rng.choice(['PASS', '.', 'q10', 'q10;LowQual'])} {rng.choice(['.', 'DP=3;EFF=x', 'DP=4.5;SOMATIC', 'EFF=.;DP=2'])} {fmt} " + " ".join(cols))
        frames.append(load(spark, META + HEAD + " ".join(f"s{f}_{i}" for i in range(n)) + "\n" + "\n".join(rows) + "\n", tmp_path, f"f{f}.vcf"))
    for o in (MergeOptions(), MergeOptions("all", missing_to_ref=True), MergeOptions("none", no_update=True, info_rules="DP:avg,EFF:join")):
        assert body(merge(frames, o)) == body(merge(frames, o, force_general=True))


def test_merge_errors(spark, files, tmp_path):
    f = read_vcf(spark, str(files / "x1.vcf"))
    with pytest.raises(VcfError, match="duplicate sample"):
        merge([f, f])
    assert merge([f, f], MergeOptions(force_samples=True)).header.samples == ["X1", "X2", "2:X1", "2:X2"]
    with pytest.raises(VcfError):
        merge([f])
    g = load(spark, META + HEAD + "Z\nchr1 20 . A G . . . GT 0/1\nchr1 10 . A G . . . GT 0/1\n", tmp_path)
    with pytest.raises(VcfError, match="not coordinate-sorted"):
        merge([f, g])
    with pytest.raises(VcfError):
        MergeOptions("some")


def test_undeclared_contigs(spark, tmp_path):
    a = load(spark, META + HEAD + "A\nchr1 5 . A G . . . GT 0/1\nz 5 . A G . . . GT 0/1\ny 1 . A G . . . GT 0/1\n", tmp_path, "a.vcf")
    b = load(spark, META + HEAD + "B\ny 1 . A G . . . GT 0/0\n", tmp_path, "b.vcf")
    # input 2 starts at y, so y is ranked before input 1 comes to z; then input 1 would fall back, which is an error
    with pytest.raises(VcfError, match="not coordinate-sorted"):
        merge([a, b])
    c = load(spark, META + HEAD + "C\nz 7 . A G . . . GT 0/0\n", tmp_path, "c.vcf")
    assert [x.split()[:2] for x in body(merge([a, c]))] == [["chr1", "5"], ["z", "5"], ["z", "7"], ["y", "1"]]


def test_view(spark, files):
    f = read_vcf(spark, str(files / "x1.vcf"))
    pick = lambda **k: [x.split()[1] for x in body(view(f, ViewOptions(**k)))]
    assert pick(types="snps") == ["100", "200"]
    assert pick(exclude_types="snps") == ["300", "500"]
    assert pick(min_alleles=3) == ["200"]
    assert pick(max_alleles=2) == ["100", "300", "500"]
    assert pick(filters="q10") == ["300"]
    assert pick(ids="rsA,rsX") == ["200"]
    assert pick(min_qual=60, max_qual=69.5) == ["200"]
    assert pick(min_ac=2) == ["300", "500"]
    assert pick(regions="chr1:150-300,chr2") == ["200", "300"]
    assert pick(regions="chr1:-200") == ["100", "200"]
    assert body(view(f, ViewOptions(samples="X2")))[1] == "chr1 200 rsA C T,G 60 PASS AC=0,0;AN=2;DP=20;EFF=a,b GT:AD 0/0:8,1,1"
    assert body(view(f, ViewOptions(samples="X2,X1")))[0] == "chr1 100 . A G 50 PASS AC=1;AN=4;DP=10;EFF=mis GT:AD 0/0:9,1 0/1:5,6"
    assert body(view(f, ViewOptions(samples="^X1", no_update=True)))[0] == "chr1 100 . A G 50 PASS AC=1;AN=4;DP=10;EFF=mis GT:AD 0/0:9,1"
    assert body(view(f, ViewOptions(drop_genotypes=True)))[0] == "chr1 100 . A G 50 PASS AC=1;AN=4;DP=10;EFF=mis"
    assert view(f, ViewOptions(drop_genotypes=True)).header.text().splitlines()[-1].endswith("INFO")
    with pytest.raises(VcfError, match="not present"):
        view(f, ViewOptions(samples="nobody"))
    with pytest.raises(VcfError):
        view(f, ViewOptions(samples="X1", samples_file="x"))


def test_view_quirks(spark, tmp_path):
    f = load(spark, META + HEAD + "A B\nchr1 1 . A . . . . GT 0/0 0/1\nchr1 2 . A G nan . DP=1 DP 3 4\nchr1 3 . A G 5 . . GT 0/1\n", tmp_path)
    got = body(view(f, ViewOptions(samples="A")))
    assert got == ["chr1 1 . A . . . AC=;AN=2 GT 0/0", "chr1 2 . A G nan . DP=1 DP 3", "chr1 3 . A G 5 . AC=1;AN=2 GT 0/1"]
    assert [x.split()[1] for x in body(view(f, ViewOptions(min_qual=100)))] == ["2"]
    assert [x.split()[1] for x in body(view(f, ViewOptions(max_qual=1)))] == ["1", "2"]
    assert body(view(f, ViewOptions(samples="B,B", no_update=True)))[2].split()[9:] == [".", "."]
    g = load(spark, META + HEAD + "A\nchr1 900 . A G . . . GT 0/1\nchr1 10 . A G . . . GT 0/1\n", tmp_path, "b.vcf")
    assert len(body(view(g, ViewOptions(regions="chr1:1-100")))) == 1
    assert body(view(g, ViewOptions(regions="chr1:1-100", strict_stop=True))) == []


def test_concat(spark, files, tmp_path):
    f = read_vcf(spark, str(files / "x1.vcf"))
    parts = [view(f, ViewOptions(regions=r)) for r in ("chr1:1-250", "chr1:251-")]
    assert body(concat(parts)) == body(f)
    with pytest.raises(VcfError, match="other samples"):
        concat([f, read_vcf(spark, str(files / "x2.vcf"))])


def test_passthrough_keeps_lines(spark, tmp_path):
    (tmp_path / "a.vcf").write_bytes(tabs(META + HEAD + "A").encode() + b"chr1\t1\t.\tA\tG\t.\t.\t.\tGT\t0/1\r\n\nshort\n# note\nchr1\t2\t.\tA\tG\t.\t.\t.\tGT\t1/1")
    f = read_vcf(spark, str(tmp_path / "a.vcf"))
    write_vcf(view(f), str(tmp_path / "o.vcf"))
    lines = (tmp_path / "o.vcf").read_text().split("\n")
    assert lines[-6:] == ["chr1\t1\t.\tA\tG\t.\t.\t.\tGT\t0/1", "", "short", "# note", "chr1\t2\t.\tA\tG\t.\t.\t.\tGT\t1/1", ""]
    assert len(body(view(f, ViewOptions(min_alleles=1)))) == 2
    assert [x for x in body(concat([f, f])) if not x] == []


@pytest.mark.parametrize("kind", ["plain", "gzip", "bgzf", "bgzf-odd-name"])
def test_files_of_every_kind(spark, tmp_path, kind):
    rows = "".join(f"chr1 {i} r{i} A G {i} PASS DP={i % 97} GT 0/{i % 2}\n" for i in range(1, 40001))
    text = tabs(META + HEAD + "A\n" + rows)
    path = tmp_path / ("a.vcf.gz" if kind in ("gzip", "bgzf") else "a.vcf")
    if kind == "plain":
        path.write_text(text)
    elif kind == "gzip":
        path.write_bytes(gzip.compress(text[:1000].encode()) + gzip.compress(text[1000:].encode()))
    else:
        data = list(bgzf.blocks(iter([text.encode()])))
        path.write_bytes(b"".join([*data[:3], bgzf.EOF_BLOCK, *data[3:], bgzf.EOF_BLOCK]))
    f = read_vcf(spark, str(path))
    assert f.header.samples == ["A"]
    if kind.startswith("bgzf"):
        spark.dataSource.register(bgzf.BgzfSource)
        parts = spark.read.format("bgzf").option("path", str(path)).option("bytes_each", "20000").load()
        assert parts.rdd.getNumPartitions() > 2
        assert [r["value"] for r in parts.orderBy("block", "mid").collect()] == text.split("\n")[:-1]
    for out in ("plain", "bgzf"):
        write_vcf(f, str(tmp_path / out), out)
        data = (tmp_path / out).read_bytes()
        assert (gzip.decompress(data) if out == "bgzf" else data).decode() == text
    assert gzip.decompress((tmp_path / "bgzf").read_bytes()).endswith(b"\n")
    concat_bytes(spark, [str(tmp_path / "bgzf")] * 2, str(tmp_path / "twice"))
    assert gzip.decompress((tmp_path / "twice").read_bytes()).decode() == text + "".join(x + "\n" for x in text.split("\n")[12:-1])


def test_header():
    body_ = 'ID=q10,Description="a, \\"b\\" > c",Number=1>'
    assert (attr(body_, "ID"), attr(body_, "Number"), attr(body_, "None")) == ("q10", "1", None)
    h = VcfHeader.parse(tabs(X1).splitlines())
    assert h.samples == ["X1", "X2"] and h.has_format and h.numbers("FORMAT")["AD"] == "R" and h.contigs == ["chr1"]
    assert h.select("X2,X1,X2") == [1, 0, 1] and h.select("^X1") == [1]
    u = union([h, VcfHeader.parse(tabs(X2).splitlines())])
    assert u.meta[0] == "##fileformat=VCFv4.2" and sum("ID=DP" in x for x in u.meta) == 2 and len(u.meta) == len(h.meta) + 1
    for bad in (["##a"], ["chr1\t1"]):
        with pytest.raises(VcfError):
            VcfHeader.parse(bad)


def test_regions(spark):
    r = Regions.parse("chr1,chr2:100-200,chr3:50,chr4:10-,chr4:1-9,chr2:201-300,chr5:5-2")
    assert r.by == {"chr1": [(1, END)], "chr2": [(100, 300)], "chr3": [(50, 50)], "chr4": [(1, END)], "chr5": [(5, 2)]}
    assert Regions.read(["# x\n", "c\t5\n", "c\t1,000\t2,000\textra\n", "d\n"]).by == {"c": [(5, 5), (1000, 2000)], "d": [(1, END)]}
    with pytest.raises(VcfError):
        Regions.parse("c:x-1")
    t = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 20, 30), ("a", 22, 23), ("b", 1, 1)], "r_chrom string, r_start long, r_end long")
    assert sorted(map(tuple, coalesced(t).collect())) == [("a", 1, 9), ("a", 20, 30), ("b", 1, 1)]


def test_scalars(spark):
    from pyspark.sql import functions as F

    cases = [("A", "G", 1), ("A", "AT", 2), ("AT", "A", 2), ("AT", "GC", 4), ("AT", "GT", 1), ("A", "<DEL>", 8), ("A", "*", 8), ("A", ".", 16), ("A", "G,AT", 3), ("A", "a[chr1:5[", 8), ("A", "A", 16), ("a", "x", 8)]
    t = spark.createDataFrame(cases, "r string, a string, want int")
    assert t.filter(X.site_types(F.col("r"), F.col("a")) != F.col("want")).collect() == []
    g = spark.createDataFrame([("0/1", [0, 1]), ("./.", [None, None]), ("12|3", [12, 3]), ("1", [1]), ("0/1/1", [0, 1, 1])], "g string, want array<int>")
    assert g.filter(~F.col("want").eqNullSafe(X.gt_alleles(F.col("g")))).collect() == []
    q = [(x, y) for x, y in (("5", 5.0), (" 5 ", None), ("1.0d", None), ("1e3", 1000.0), (".5", 0.5), ("-inf", float("-inf")), (".", None), ("5.", 5.0))]
    assert spark.createDataFrame(q, "q string, want double").filter(~F.col("want").eqNullSafe(X.double(F.col("q")))).collect() == []
    i = [("AC=1;AN=2;DP=3", "AC=9;DP=3;NEW=x"), (".", "AC=9;NEW=x"), ("DP;AN=1", "DP;AC=9;NEW=x")]
    up = {"AC": F.lit("9"), "AN": F.lit(None).cast("string"), "NEW": F.lit("x")}
    assert [r[0] for r in spark.createDataFrame(i, "i string, want string").select(X.rewrite_info(F.col("i"), up)).collect()] == [w for _, w in i]
    one = spark.createDataFrame([("AN=1",)], "i string").select(X.rewrite_info(F.col("i"), {"AN": F.lit(None).cast("string")}))
    assert one.first()[0] == "."
    assert X.parse_types("snps,indel,other") == 11
    with pytest.raises(VcfError):
        X.parse_types("all")


def test_folds():
    assert [rendered(x) for x in (2.0, 0.5, 5e-7, 0.1234565, 1e15, -3.25)] == ["2", "0.5", "0", "0.123456", "1000000000000000", "-3.25"]
    assert renumbered("0/1|.", [0, 2]) == "0/2|." and renumbered("3", [0, 1]) == "."
    assert reindexed("1,2", [0, 2, 1], 3, 1) == "2,1,." and reindexed("5,6", [0, 2], 3, 0) == "5,.,6"
    f = lambda a, b, rule: merged_info([a, b], {"S": "A", "G": "G"}, parse_rules(rule), frozenset(), [None, None], 1)
    assert f("D=1,2", "D=3", "D:sum") == "D=4,2" and f("D=1", "D=2.5", "D:avg") == "D=1.75" and f("D=.", "D=4", "D:max") == "D=4"
    assert f("D=1", "D=.", "D:join") == "D=1,." and f("D=7", "D=3", "D:first") == "D=7" and f("D=7", "D=3", "D:min") == "D=3"
    assert f("D=7", "D=3", "-") == "D=7" and f("S=.,b", "S=a,c", "-") == "S=a,b" and f("F", "F=1", "-") == "F" and f(".", ".", "-") == "."
    for bad in ("D", "D:median", ":sum"):
        with pytest.raises(VcfError):
            parse_rules(bad)


def test_cli(spark, files, tmp_path, capfd):
    from locusframe.cli import run

    run(["merge", str(files / "x1.vcf"), str(files / "x2.vcf"), "-o", str(tmp_path / "m.vcf.gz")], spark)
    text = gzip.decompress((tmp_path / "m.vcf.gz").read_bytes()).decode().splitlines()
    assert [x.replace("\t", " ") for x in text if not x.startswith("#")] == [AT100, *MIDDLE, SNP500, INDEL500]
    run(["view", "-H", "-v", "snps", str(tmp_path / "m.vcf.gz"), "-o", str(tmp_path / "v.vcf")], spark)
    assert len((tmp_path / "v.vcf").read_text().splitlines()) == 4
    run(["view", "-h", str(files / "x1.vcf"), "-o", str(tmp_path / "h.vcf")], spark)
    assert (tmp_path / "h.vcf").read_text().splitlines()[-1].startswith("#CHROM")
    (tmp_path / "list").write_text(f"# two\n{files / 'x1.vcf'}\n\n{files / 'x1.vcf'}\n")
    run(["concat", "-F", str(tmp_path / "list"), "-o", str(tmp_path / "c.vcf")], spark)
    assert len([x for x in (tmp_path / "c.vcf").read_text().splitlines() if x[0] != "#"]) == 8


def test_stream(spark, files, tmp_path):
    from locusframe.streaming import view_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text(tabs(X1))
    q = view_stream(spark, str(tmp_path / "in"), VcfHeader.parse(tabs(X1).splitlines()), ViewOptions(types="snps")).select("pos_raw").writeStream.format("memory").queryName("seen").start()
    try:
        q.processAllAvailable()
        assert sorted(r[0] for r in spark.table("seen").collect()) == ["100", "200"]
    finally:
        q.stop()


def test_long_lists(spark, tmp_path):
    rows = "".join(f"chr1 {i} {'r%d;q%d' % (i, i) if i % 3 == 0 else 'r%d' % i} A G . . . GT 0/1\n" for i in range(1, 301))
    f = load(spark, META + HEAD + "A\n" + rows, tmp_path)
    wanted = {f"r{i}" for i in range(5, 50)} | {f"q{i}" for i in range(200, 2000)}
    (tmp_path / "ids").write_text("# ids\n" + "\n".join(sorted(wanted)) + "\n")
    got = [x.split()[1] for x in body(view(f, ViewOptions(ids_file=str(tmp_path / "ids"))))]
    assert got == [str(i) for i in range(1, 301) if f"r{i}" in wanted or i % 3 == 0 and f"q{i}" in wanted]
    (tmp_path / "regions").write_text("".join(f"chr1\t{i}\t{i + 1}\n" for i in range(1, 300, 7)))
    got = [int(x.split()[1]) for x in body(view(f, ViewOptions(regions_file=str(tmp_path / "regions"))))]
    assert got == [i for i in range(1, 301) if i % 7 in (1, 2)]
    (tmp_path / "names").write_text("A extra\n")
    assert view(f, ViewOptions(samples_file=str(tmp_path / "names"))).header.samples == ["A"]
    assert view(f, ViewOptions(samples_file="^" + str(tmp_path / "names"))).header.samples == []


def test_header_union_takes_all_rows(spark, tmp_path):
    from locusframe.plans import catalog

    spark.range(150).selectExpr("cast(id as int) as n_nationkey", "cast(id as int) as n_regionkey").write.parquet(str(tmp_path / "nation.parquet"))
    lines = [r["line"] for r in catalog.QUERIES["header_union"](spark, str(tmp_path)).collect()]
    assert sum(x.startswith("##contig=") for x in lines) == 150
