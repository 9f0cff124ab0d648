"""Reading and writing datasets: a folder of Parquet tables, Matrix Market text, and h5ad where h5py is installed.

Layout: X/, obs/, var/, obsm/<key>/, varm/<key>/, obsp/<key>/, varp/<key>/, uns.json. A slot is a table of its own, so
reading one never touches the others, and column lists and filters reach the Parquet scan."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verbs
from ..operators.cells import SingleCell
from ..operators.pseudobulk import DE, Pseudobulk

KEYED = ("obsm", "varm", "obsp", "varp")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _fresh(spark: SparkSession, path: str, overwrite: bool) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p):
        if not overwrite:
            raise FileExistsError(path)
        fs.delete(p, True)


def save(sc: SingleCell, directory: str, overwrite: bool = False, X: bool = True) -> None:
    spark = sc.obs.sparkSession
    _fresh(spark, directory, overwrite)
    tables = {"obs": sc.obs, "var": sc.var} | ({"X": sc.X} if X and sc.X is not None else {})
    tables |= {f"{s}/{k}": t for s in KEYED for k, t in getattr(sc, s).items()}
    for name, t in tables.items():
        t.write.parquet(f"{directory}/{name}")
    # one small file, by Spark's own writer, so that any file system will do
    spark.createDataFrame([(json.dumps(sc.uns),)], "value string").coalesce(1).write.text(f"{directory}/uns")


def read_slot(spark: SparkSession, directory: str, slot: str, columns: list[str] | None = None) -> DataFrame:
    t = spark.read.parquet(f"{directory}/{slot}")
    return t.select(*columns) if columns else t


def read_obs(spark, directory, columns=None):
    return read_slot(spark, directory, "obs", columns)


def read_var(spark, directory, columns=None):
    return read_slot(spark, directory, "var", columns)


def _read_keyed(slot):
    def read(spark: SparkSession, directory: str, keys: list[str] | None = None) -> dict[str, DataFrame]:
        return {k: read_slot(spark, directory, f"{slot}/{k}") for k in (keys if keys is not None else children(spark, f"{directory}/{slot}"))}

    return read


read_obsm, read_varm, read_obsp, read_varp = map(_read_keyed, KEYED)


def read_uns(spark: SparkSession, directory: str) -> dict:
    return json.loads(spark.read.text(f"{directory}/uns").first()[0])


def load(spark: SparkSession, path: str, X: bool = True) -> SingleCell:
    """A dataset from a folder, or from a .mtx or .h5ad file."""
    if path.endswith((".mtx", ".mtx.gz")):
        return read_mtx(spark, path)
    if path.endswith(".h5ad"):
        return read_h5ad(spark, path)
    keyed = {s: r(spark, path) for s, r in zip(KEYED, (read_obsm, read_varm, read_obsp, read_varp))}
    return SingleCell(read_slot(spark, path, "X") if X and exists(spark, f"{path}/X") else None, read_obs(spark, path), read_var(spark, path), **keyed, uns=read_uns(spark, path))


def ls(spark: SparkSession, path: str) -> DataFrame:
    """slot, column, type of what a folder holds, without reading X."""
    slots = [c for c in children(spark, path) if c not in ("uns", *KEYED)] + [f"{s}/{k}" for s in KEYED for k in children(spark, f"{path}/{s}")]
    rows = [(s, f.name, f.dataType.simpleString()) for s in slots for f in spark.read.parquet(f"{path}/{s}").schema]
    return spark.createDataFrame(rows, "slot string, column string, type string")


def _first_lines(spark: SparkSession, path: str, most: int = 1000) -> list[str]:
    """Lines from the beginning of a text file, read from its first bytes; .gz files as well."""
    fs, p = _fs(spark, path)
    jvm = spark._jvm
    stream = fs.open(p)
    if path.endswith(".gz"):
        stream = jvm.java.util.zip.GZIPInputStream(stream)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        out = []
        while len(out) < most and (line := reader.readLine()) is not None:
            out.append(line)
            if not line.startswith("%"):
                break
        return out
    finally:
        reader.close()


def read_mtx(spark: SparkSession, path: str, genes: str | None = None, barcodes: str | None = None) -> SingleCell:
    """Matrix Market text (genes by cells, as 10x writes it) with its lists of genes and barcodes beside it. The header is
    read by itself; the lines after it are read by all tasks at once. Kinds `general`, `integer`, `real` and `pattern`."""
    folder = path.rpartition("/")[0]
    name = lambda given, options: given or next(f"{folder}/{f}" for f in options if exists(spark, f"{folder}/{f}"))
    head = _first_lines(spark, path)
    kind = head[0].lower().split() if head and head[0].startswith("%%") else ["", "matrix", "coordinate", "real", "general"]
    if kind[1:3] != ["matrix", "coordinate"] or kind[3] not in ("integer", "real", "pattern") or kind[4] != "general":
        raise ValueError(f"{path}: only coordinate matrices of kind general")
    size = [int(x) for x in head[-1].split()]
    lines = spark.read.text(path).where(~F.col("value").startswith("%"))
    parts = F.split(F.trim("value"), r"\s+")
    whole = kind[3] != "real"
    value = F.lit(1) if kind[3] == "pattern" else F.col("p")[2]
    fields = 2 if kind[3] == "pattern" else 3
    x = lines.select(parts.alias("p")).where(F.size("p") == fields).select((F.col("p")[1].cast("long") - 1).alias("row_id"), (F.col("p")[0].cast("long") - 1).alias("col_id"), value.cast("double").alias("value"))
    if fields == 3:
        # the size line looks like an entry; a file may have an entry of the same three numbers in the last cell and gene,
        # so that one such line goes
        same = (F.col("row_id") == size[1] - 1) & (F.col("col_id") == size[0] - 1) & (F.col("value") == size[2])
        real = x.where(~same)
        x = real.unionByName(x.where(same).limit(1)) if x.where(same).count() > 1 else real
    x = x.where("value <> 0")
    if whole or lines.where(F.col("value").rlike("[.eE]")).limit(1).isEmpty():
        x = x.withColumn("value", F.col("value").cast("long"))

    def table(file: str, key: str, names: list[str]) -> DataFrame:
        # lines are numbered in the order of the file: splits by where they begin, lines within them as they come
        at = F.col("_metadata.file_block_start") if not file.endswith(".gz") else F.lit(0)
        t = spark.read.text(file).select("value", at.alias("_split"), F.monotonically_increasing_id().alias("_line"))
        return verbs.numbered(t, [F.asc("_split"), F.asc("_line")], name=key).select(key, *(F.split("value", "\t")[i].alias(n) for i, n in enumerate(names)))

    var = table(name(genes, ["features.tsv.gz", "features.tsv", "genes.tsv.gz", "genes.tsv"]), "col_id", ["id", "gene"]).select("col_id", F.coalesce("gene", "id").alias("gene"), "id")
    return SingleCell(x, table(name(barcodes, ["barcodes.tsv.gz", "barcodes.tsv"]), "row_id", ["barcode"]), var)


def _one_file(spark: SparkSession, lines: DataFrame, path: str, head: str = "") -> None:
    """The lines (value), in the order of the table's partitions, as one text file after head. All tasks write parts; these
    are joined by the file system itself where it can (concat), else copied one after another, a buffer at a time."""
    jvm, parts = spark._jvm, f"{path}.parts"
    lines.write.mode("overwrite").text(parts)
    fs, target = _fs(spark, path)
    names = [p for p in children(spark, parts) if p.startswith("part-")]
    paths = [jvm.org.apache.hadoop.fs.Path(f"{parts}/{n}") for n in names]
    out = fs.create(target, True)
    try:
        out.write(bytearray(head.encode()))
    finally:
        out.close()
    try:
        array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(paths))
        for k, p in enumerate(paths):
            array[k] = p
        if not head or not paths:
            raise ValueError("nothing to join to")
        fs.concat(target, array)
    except Exception:  # most file systems cannot: then the parts are copied
        out = fs.create(target, True)
        try:
            out.write(bytearray(head.encode()))
            for p in paths:
                part = fs.open(p)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
        finally:
            out.close()
    fs.delete(jvm.org.apache.hadoop.fs.Path(parts), True)


def save_mtx(sc: SingleCell, directory: str, overwrite: bool = False) -> None:
    """matrix.mtx (genes by cells), features.tsv and barcodes.tsv, as 10x writes them: names and counts, and nothing else
    of the dataset. Cells and genes are numbered in the order of their ids; entries stand in the order of cells, then
    genes. The header's totals are counted first. Names with tabs or line ends, and null names, raise ValueError."""
    spark = sc.obs.sparkSession
    _fresh(spark, directory, overwrite)
    numbers = {}
    for axis, key, file in (("obs", "row_id", "barcodes.tsv"), ("var", "col_id", "features.tsv")):
        name = sc.name_column(axis)
        table = getattr(sc, axis).select(key, F.col(name).cast("string").alias("name"))
        if bad := table.where(F.col("name").isNull() | F.col("name").rlike(r"[\t\r\n]")).limit(1).collect():
            raise ValueError(f"{bad[0]['name']!r} can't be written as a name")
        numbers[key] = verbs.numbered(table, [F.asc(key)], name="at")
        line = F.col("name") if axis == "obs" else F.concat_ws("\t", "name", "name", F.lit("Gene Expression"))
        _one_file(spark, numbers[key].repartitionByRange("at").sortWithinPartitions("at").select(line.alias("value")), f"{directory}/{file}")
    places = {key: t.select(key, (F.col("at") + 1).alias(f"{key}_at")) for key, t in numbers.items()}
    # places are as many as cells and genes: packed small, they would be broadcast, and unpacked on the driver
    x = sc.X.join(places["row_id"].hint("merge"), "row_id").join(places["col_id"].hint("merge"), "col_id").select("row_id_at", "col_id_at", "value")
    whole = x.schema["value"].dataType.typeName() not in ("float", "double")
    cells, genes = sc.shape
    entries = x.repartitionByRange("row_id_at", "col_id_at").sortWithinPartitions("row_id_at", "col_id_at")
    head = f"%%MatrixMarket matrix coordinate {'integer' if whole else 'real'} general\n{genes} {cells} {x.count()}\n"
    _one_file(spark, entries.select(F.concat_ws(" ", "col_id_at", "row_id_at", F.col("value").cast("string")).alias("value")), f"{directory}/matrix.mtx", head)


def read_h5ad(spark: SparkSession, path: str) -> SingleCell:
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading .h5ad needs h5py") from e
    import numpy as np
    import pandas as pd

    def frame(g, key):
        index = g.attrs.get("_index", "_index")
        text = lambda a: [v.decode() if isinstance(v, bytes) else v for v in a]
        cols = {index: text(g[index][:])}
        for c in g:
            if c != index and isinstance(g[c], h5py.Dataset):
                cols[c] = text(g[c][:])
            elif c != index and "codes" in g[c]:
                names = text(g[c]["categories"][:])
                cols[c] = [names[k] if k >= 0 else None for k in g[c]["codes"][:]]
        return spark.createDataFrame(pd.DataFrame(cols).assign(**{key: np.arange(len(cols[index]))})[[key, *cols]])

    with h5py.File(path) as f:
        x = f["layers/counts"] if "layers" in f and "counts" in f["layers"] else f["X"]
        n = len(x["indptr"]) - 1
        rows = np.repeat(np.arange(n), np.diff(x["indptr"][:]))
        table = spark.createDataFrame(pd.DataFrame({"row_id": rows, "col_id": x["indices"][:].astype(np.int64), "value": x["data"][:]}))
        return SingleCell(table, frame(f["obs"], "row_id"), frame(f["var"], "col_id"))


def save_pseudobulk(pb: Pseudobulk, directory: str, overwrite: bool = False) -> None:
    _fresh(pb.obs.sparkSession, directory, overwrite)
    for s in ("X", "obs", "var"):
        getattr(pb, s).write.partitionBy("cell_type").parquet(f"{directory}/{s}")


def load_pseudobulk(spark: SparkSession, directory: str) -> Pseudobulk:
    # names of folders are text, also where they look like numbers
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        tables = [spark.read.parquet(f"{directory}/{s}") for s in ("X", "obs", "var")]
    finally:
        spark.conf.set(key, before)
    return Pseudobulk(*(t.select("cell_type", *(c for c in t.columns if c != "cell_type")) for t in tables))


def save_de(de: DE, directory: str, overwrite: bool = False) -> None:
    _fresh(de.table.sparkSession, directory, overwrite)
    de.table.write.parquet(f"{directory}/table")
    for name in ("voom_plot_data", "voom_weights"):
        if getattr(de, name) is not None:
            getattr(de, name).write.parquet(f"{directory}/{name}")


def load_de(spark: SparkSession, directory: str) -> DE:
    paths = [f"{directory}/{name}" for name in ("voom_plot_data", "voom_weights")]
    return DE(spark.read.parquet(f"{directory}/table"), *(spark.read.parquet(p) if exists(spark, p) else None for p in paths))


SingleCell.save = save
SingleCell.save_mtx = save_mtx
for _slot in ("obs", "var"):
    setattr(SingleCell, f"read_{_slot}", staticmethod(globals()[f"read_{_slot}"]))
Pseudobulk.save = save_pseudobulk
DE.save = save_de
