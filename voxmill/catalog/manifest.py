"""Queries on file manifests and splits; file names come from document and customer keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.catalog.base import flat, query
from voxmill.catalog.inputs import htoken, table
from voxmill.operators import manifest as M
from voxmill.operators import splits as S


def padded(key, width: int):
    """A number with zeros in front, up to ``width`` digits; longer ones stay whole."""
    shown = key.cast("string")
    return F.lpad(shown, F.greatest(F.lit(width), F.length(shown)), F.lit("0"))


def image_files(spark, sf):
    """Two channels per document (one for every 17th), some hidden, some of another kind."""
    key = padded(F.col("doc_id"), 5)
    name = F.concat(F.when(F.col("doc_id") % 29 == 0, ".").otherwise(""), F.lit("case_"), key, F.lit("_000"),
                    F.col("c").cast("string"), F.when(F.col("doc_id") % 31 == 0, ".txt").otherwise(".nii.gz"))
    folder = F.when(F.col("doc_id") % 10 == 9, "imagesTs").when(F.col("doc_id") % 10 == 8, "imagesVal").otherwise("imagesTr")
    return (table(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("c"))
            .filter("NOT (c = 1 AND doc_id % 17 = 0)").select(F.concat(folder, F.lit("/"), name).alias("path")))


def label_files(spark, sf):
    key = padded(F.col("doc_id"), 5)
    folder = F.when(F.col("doc_id") % 10 == 9, "labelsTs").when(F.col("doc_id") % 10 == 8, "labelsVal").otherwise("labelsTr")
    return table(spark, sf, "labels").select(F.concat(folder, F.lit("/case_"), key, F.lit(".nii.gz")).alias("path"))


FILES = """
images AS (SELECT doc_id, c, CASE doc_id % 10 WHEN 9 THEN 'imagesTs' WHEN 8 THEN 'imagesVal' ELSE 'imagesTr' END || '/' ||
    CASE WHEN doc_id % 29 = 0 THEN '.' ELSE '' END || 'case_' || lpad(doc_id::VARCHAR, greatest(5, length(doc_id::VARCHAR))::INT, '0') || '_000' || c ||
    CASE WHEN doc_id % 31 = 0 THEN '.txt' ELSE '.nii.gz' END AS path
  FROM documents, (VALUES (0), (1)) v(c) WHERE NOT (c = 1 AND doc_id % 17 = 0)),
labelf AS (SELECT doc_id, CASE doc_id % 10 WHEN 9 THEN 'labelsTs' WHEN 8 THEN 'labelsVal' ELSE 'labelsTr' END ||
    '/case_' || lpad(doc_id::VARCHAR, greatest(5, length(doc_id::VARCHAR))::INT, '0') || '.nii.gz' AS path FROM labels),
both_files AS (SELECT path FROM images UNION ALL SELECT path FROM labelf),
named AS (SELECT path, split_part(path, '/', 1) AS folder, split_part(path, '/', 2) AS name FROM both_files),
stems AS (SELECT *, regexp_replace(name, '\\.nii\\.gz$', '') AS stem FROM named WHERE name LIKE '%.nii.gz' AND name NOT LIKE '.%'),
manifest AS (SELECT path,
   CASE right(folder, 2) WHEN 'Tr' THEN 'train' WHEN 'Ts' THEN 'test' ELSE 'val' END AS split,
   CASE WHEN folder LIKE 'images%' THEN 'image' ELSE 'label' END AS kind,
   CASE WHEN regexp_matches(stem, '^(.+)_(\\d{4})$') THEN regexp_extract(stem, '^(.+)_(\\d{4})$', 1) ELSE stem END AS case_id,
   CASE WHEN regexp_matches(stem, '^(.+)_(\\d{4})$') THEN regexp_extract(stem, '^(.+)_(\\d{4})$', 2)::INT ELSE 0 END AS channel
  FROM stems),
tr AS (SELECT * FROM manifest WHERE split = 'train' AND kind = 'image'),
lb AS (SELECT * FROM manifest WHERE split = 'train' AND kind = 'label')"""


def sql(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([FILES, *more]) + "\n" + body


def full_manifest(spark, sf):
    return M.manifest_of(image_files(spark, sf).unionByName(label_files(spark, sf)))


def train_images(spark, sf):
    return full_manifest(spark, sf).filter("split = 'train' AND kind = 'image'")


def train_labels(spark, sf):
    return full_manifest(spark, sf).filter("split = 'train' AND kind = 'label'")


@query("visible_files", sql("SELECT path FROM images WHERE path LIKE '%.nii.gz' AND path NOT LIKE '%/.%'"))
def _(spark, sf):
    return M.visible_files(image_files(spark, sf))


@query("parse_case_channel", sql("SELECT * FROM manifest"))
def _(spark, sf):
    return full_manifest(spark, sf)


@query("split_manifest", sql("""
SELECT i.case_id, i.channel, i.path, l.path AS label_path FROM (SELECT * FROM manifest WHERE split = 'val' AND kind = 'image') i
LEFT JOIN (SELECT * FROM manifest WHERE split = 'val' AND kind = 'label') l USING (case_id)"""))
def _(spark, sf):
    return M.split_manifest(full_manifest(spark, sf), "val")


@query("group_cases", sql("""
SELECT case_id, string_agg(path, ',' ORDER BY channel) AS paths FROM tr GROUP BY 1 HAVING count(*) = 2"""))
def _(spark, sf):
    return flat(M.group_cases(train_images(spark, sf), 2, on_mismatch="drop"), "paths")


@query("channel_mismatches", sql(
    "SELECT case_id, count(*) AS n_channels FROM tr GROUP BY 1 HAVING count(*) <> 2"))
def _(spark, sf):
    return M.channel_mismatches(train_images(spark, sf), 2)


@query("report_first", sql("""
SELECT count(*) AS n_bad, (SELECT string_agg(case_id, ', ' ORDER BY case_id) FROM (SELECT case_id FROM bad ORDER BY 1 LIMIT 5)) AS first,
  greatest(count(*) - 5, 0) AS more FROM bad""",
                           "bad AS (SELECT case_id FROM tr GROUP BY 1 HAVING count(*) <> 2)"))
def _(spark, sf):
    return M.report_first(M.channel_mismatches(train_images(spark, sf), 2), "case_id")


@query("match_labels", sql("""
SELECT c.case_id, l.path AS label_path FROM (SELECT DISTINCT case_id FROM tr) c LEFT JOIN lb l USING (case_id)"""))
def _(spark, sf):
    return M.match_labels(train_images(spark, sf), train_labels(spark, sf))


@query("missing_labels", sql("SELECT DISTINCT case_id FROM tr WHERE case_id NOT IN (SELECT case_id FROM lb)"))
def _(spark, sf):
    return M.missing_labels(train_images(spark, sf), train_labels(spark, sf))


@query("surplus_labels", sql("""
SELECT n_cases, n_labels, n_labels > n_cases AS more_labels FROM (
  SELECT (SELECT count(DISTINCT case_id) FROM tr) AS n_cases, (SELECT count(DISTINCT case_id) FROM lb) AS n_labels)"""))
def _(spark, sf):
    return M.surplus_labels(train_images(spark, sf), train_labels(spark, sf))


@query("pair_existing", sql("SELECT * FROM tr WHERE case_id IN (SELECT case_id FROM lb)"))
def _(spark, sf):
    return M.pair_existing(train_images(spark, sf), train_labels(spark, sf))


@query("unpaired", sql("""
SELECT DISTINCT case_id, 'label' AS missing FROM tr WHERE case_id NOT IN (SELECT case_id FROM lb)
UNION ALL SELECT DISTINCT case_id, 'image' FROM lb WHERE case_id NOT IN (SELECT case_id FROM tr)"""))
def _(spark, sf):
    return M.unpaired(train_images(spark, sf), train_labels(spark, sf))


@query("common_cases", sql("SELECT case_id FROM tr INTERSECT SELECT case_id FROM lb"))
def _(spark, sf):
    return M.common_cases(train_images(spark, sf), train_labels(spark, sf))


PROPS = """props AS (SELECT 'case_' || lpad(doc_id::VARCHAR, greatest(5, length(doc_id::VARCHAR))::INT, '0') AS case_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0)"""


def properties(spark, sf):
    return table(spark, sf, "labels").filter("doc_id % 3 <> 0").select(
        F.concat(F.lit("case_"), padded(F.col("doc_id"), 5)).alias("case_id"), "quality", "toxic")


@query("pair_arrays_with_properties", sql("SELECT tr.*, quality, toxic FROM tr JOIN props USING (case_id)", PROPS))
def _(spark, sf):
    return M.pair_arrays_with_properties(train_images(spark, sf), properties(spark, sf))


@query("arrays_without_properties", sql("SELECT DISTINCT case_id FROM tr WHERE case_id NOT IN (SELECT case_id FROM props)", PROPS))
def _(spark, sf):
    return M.arrays_without_properties(train_images(spark, sf), properties(spark, sf))


LABEL_MAPS = """
maps AS (SELECT p_partkey AS dataset_id, CASE WHEN p_partkey % 2 = 0 THEN p_size % 3 || '' ELSE p_name END AS k,
                CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_size % 3 || '' END AS v FROM part
         UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '7' ELSE p_brand END,
                CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '7' END FROM part),
norm AS (SELECT dataset_id, coalesce(try_cast(k AS INT), try_cast(v AS INT)) AS label_id,
                CASE WHEN try_cast(k AS INT) IS NULL THEN k ELSE v END AS name FROM maps)"""


def label_maps(spark, sf):
    number = (F.col("p_size") % 3).cast("string")
    seven = F.lit("7")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("dataset_id"),
        F.when(F.col("p_partkey") % 2 == 0, F.create_map(number, F.col("p_name"), seven, F.col("p_brand")))
        .otherwise(F.create_map(F.col("p_name"), number, F.col("p_brand"), seven)).alias("labels"))


@query("normalize_labels", "WITH " + LABEL_MAPS + " SELECT * FROM norm")
def _(spark, sf):
    return M.normalize_labels(label_maps(spark, sf))


@query("foreground_labels", "WITH " + LABEL_MAPS + " SELECT * FROM norm WHERE label_id <> 0")
def _(spark, sf):
    return M.foreground_labels(M.normalize_labels(label_maps(spark, sf)))


NUMBERED = "SELECT 'scan_' || lpad(doc_id::VARCHAR, greatest(4, length(doc_id::VARCHAR))::INT, '0') AS case_id, lang FROM documents"


def numbered_cases(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit("scan_"), padded(F.col("doc_id"), 4)).alias("case_id"), "lang")


for _mod, _op in (("ct", "<= 500"), ("mri", "> 500")):
    @query(f"modality_filter_{_mod}",
           f"SELECT * FROM ({NUMBERED}) WHERE split_part(case_id, '_', 2)::INT {_op}")
    def _(spark, sf, mod=_mod):
        return M.modality_filter(numbered_cases(spark, sf), mod)


@query("merge_validation", f"""
SELECT case_id, CASE lang WHEN 'en' THEN 'train' WHEN 'de' THEN 'train' ELSE 'test' END AS split FROM ({NUMBERED})""")
def _(spark, sf):
    docs = numbered_cases(spark, sf)
    return M.merge_validation(docs.filter("lang = 'en'"), docs.filter("lang = 'de'"),
                              docs.filter("lang NOT IN ('en', 'de')"), merge=True)


@query("validation_as_test", f"""
SELECT case_id, CASE lang WHEN 'en' THEN 'train' ELSE 'test' END AS split FROM ({NUMBERED})""")
def _(spark, sf):
    docs = numbered_cases(spark, sf)
    return M.merge_validation(docs.filter("lang = 'en'"), docs.filter("lang = 'de'"),
                              docs.filter("lang NOT IN ('en', 'de')"), merge=False)


# {split}/{case}/{case}-{modality}: some files are missing, all of an odd split lack labels
def modality_files(spark, sf):
    key = F.col("c_custkey")
    parts = F.array(*[F.lit(m) for m in ("T1N", "t1c", "t2f", "t2w", "seg", "extra")])
    case = F.concat(F.lit("Sub-"), padded(key, 5), F.lit("-000"))
    return (table(spark, sf, "customer")
            .select("*", case.alias("case"), F.posexplode(parts).alias("pos", "m"))
            .filter("NOT (m = 'seg' AND (c_nationkey % 2 = 1 OR c_custkey % 13 = 0))")
            .filter("(c_custkey + pos) % 11 <> 0")
            .select(F.concat(F.lit("root/part"), F.col("c_nationkey").cast("string"), F.lit("/"), "case", F.lit("/"), "case",
                             F.lit("-"), "m", F.lit(".nii.gz")).alias("path")))


MODS = """
mf AS (SELECT c_custkey, pos, m, 'part' || c_nationkey AS split_dir, 'Sub-' || lpad(c_custkey::VARCHAR, greatest(5, length(c_custkey::VARCHAR))::INT, '0') || '-000' AS case_dir
  FROM customer, (VALUES (0,'T1N'), (1,'t1c'), (2,'t2f'), (3,'t2w'), (4,'seg'), (5,'extra')) v(pos, m)
  WHERE NOT (m = 'seg' AND (c_nationkey % 2 = 1 OR c_custkey % 13 = 0)) AND (c_custkey + pos) % 11 <> 0),
pm AS (SELECT 'root/' || split_dir || '/' || case_dir || '/' || case_dir || '-' || m || '.nii.gz' AS path, lower(m) AS modality,
  case_dir, split_dir, left(case_dir, length(case_dir) - 4) AS case_id FROM mf),
have AS (SELECT case_id, count(DISTINCT modality) FILTER (WHERE modality IN ('t1n','t1c','t2f','t2w')) AS n,
  bool_or(modality = 'seg') AS has_seg FROM pm GROUP BY 1)"""


@query("parse_modality_suffix", "WITH " + MODS + " SELECT * FROM pm")
def _(spark, sf):
    return M.parse_modality_suffix(modality_files(spark, sf))


@query("split_role_inference", "WITH " + MODS + """
SELECT split_dir, CASE WHEN arg_min(s, case_dir) THEN 'train' ELSE 'test' END AS role
FROM (SELECT split_dir, case_dir, bool_or(modality = 'seg') AS s FROM pm GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    return M.split_role_inference(M.parse_modality_suffix(modality_files(spark, sf)))


@query("require_complete_cases", "WITH " + MODS + """
SELECT case_id, CASE modality WHEN 't1n' THEN 0 WHEN 't1c' THEN 1 WHEN 't2f' THEN 2 ELSE 3 END AS channel, path
FROM pm JOIN have USING (case_id) WHERE n = 4 AND has_seg AND modality NOT IN ('seg', 'extra')""")
def _(spark, sf):
    return M.require_complete_cases(M.parse_modality_suffix(modality_files(spark, sf)), need_seg=True)


@query("incomplete_cases", "WITH " + MODS + """
SELECT h.case_id, coalesce((SELECT string_agg(x.m, ',' ORDER BY x.o) FROM (VALUES (0,'t1n'),(1,'t1c'),(2,'t2f'),(3,'t2w')) x(o, m)
  WHERE NOT EXISTS (SELECT 1 FROM pm WHERE pm.case_id = h.case_id AND pm.modality = x.m)), 'seg') AS missing
FROM have h WHERE n < 4 OR NOT has_seg""")
def _(spark, sf):
    return M.incomplete_cases(M.parse_modality_suffix(modality_files(spark, sf)), need_seg=True)


@query("catalogue_channels", """
SELECT p_partkey, source, 0 AS channel, CASE WHEN source IN ('heart', 'hippocampus') THEN 'MRI' ELSE 'CT' END AS channel_name
FROM (SELECT p_partkey, ['spleen','liver','heart','hippocampus','unknown'][1 + p_size % 5] AS source FROM part) WHERE source <> 'unknown'""")
def _(spark, sf):
    names = F.array(*[F.lit(x) for x in ("spleen", "liver", "heart", "hippocampus", "unknown")])
    return M.catalogue_channels(table(spark, sf, "part").select(
        "p_partkey", F.get(names, F.col("p_size") % 5).alias("source")), unknown="drop")


@query("catalogue_labels", """
SELECT p_partkey, source, l.label_id, l.name FROM (SELECT p_partkey, ['spleen','liver','unknown'][1 + p_size % 3] AS source FROM part)
JOIN (VALUES ('spleen', 0, 'background'), ('spleen', 1, 'spleen'), ('liver', 0, 'background'), ('liver', 1, 'liver'),
  ('liver', 2, 'cancer')) l(source, label_id, name) USING (source)""")
def _(spark, sf):
    names = F.array(*[F.lit(x) for x in ("spleen", "liver", "unknown")])
    return M.catalogue_labels(table(spark, sf, "part").select(
        "p_partkey", F.get(names, F.col("p_size") % 3).alias("source")), unknown="drop")


# --- splits -------------------------------------------------------------------------

FOLDS = f"""
ids AS (SELECT DISTINCT c_custkey::VARCHAR AS case_id FROM customer),
own AS (SELECT case_id, ntile(5) OVER (ORDER BY {htoken('12345', 'case_id')}, case_id) - 1 AS own FROM ids),
splits AS (SELECT f::INT AS fold, CASE WHEN f = own THEN 'val' ELSE 'train' END AS role, case_id FROM own, range(5) r(f))"""


def customer_cases(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("case_id"))


def customer_splits(spark, sf):
    return S.kfold_splits(customer_cases(spark, sf))


@query("list_case_ids", "SELECT DISTINCT o_custkey AS case_id FROM orders ORDER BY 1")
def _(spark, sf):
    return S.list_case_ids(table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id")), check=True)


@query("kfold_splits", "WITH " + FOLDS + " SELECT * FROM splits")
def _(spark, sf):
    return customer_splits(spark, sf)


@query("fold_keys", "WITH " + FOLDS + " SELECT role, case_id FROM splits WHERE fold = 2")
def _(spark, sf):
    return S.fold_keys(customer_splits(spark, sf), 2)


@query("fold_keys_all", "WITH " + FOLDS + " SELECT role, case_id FROM ids, (VALUES ('train'), ('val')) v(role)")
def _(spark, sf):
    return S.fold_keys(customer_splits(spark, sf), "all")


@query("fold_keys_fallback", "WITH " + FOLDS + f"""
SELECT CASE WHEN n <= floor(0.8 * c) THEN 'train' ELSE 'val' END AS role, case_id FROM (
  SELECT case_id, row_number() OVER (ORDER BY {htoken('12354', 'case_id')}, case_id) AS n, count(*) OVER () AS c FROM ids)""")
def _(spark, sf):
    return S.fold_keys(customer_splits(spark, sf), 9)


@query("limit_cases", "WITH " + FOLDS + """
SELECT fold, case_id FROM splits WHERE role = 'val' QUALIFY row_number() OVER (PARTITION BY fold ORDER BY case_id) <= 10""")
def _(spark, sf):
    return S.limit_cases(customer_splits(spark, sf), 10)


@query("all_case_ids", "WITH " + FOLDS + " SELECT case_id FROM ids")
def _(spark, sf):
    return S.all_case_ids(customer_splits(spark, sf))


@query("complement", "WITH " + FOLDS + """
SELECT case_id FROM ids WHERE case_id NOT IN (SELECT case_id FROM splits WHERE fold = 1 AND role = 'train')""")
def _(spark, sf):
    return S.complement(customer_cases(spark, sf), customer_splits(spark, sf).filter("fold = 1 AND role = 'train'"))
