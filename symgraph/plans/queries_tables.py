"""Queries of the store, change detection, file filters and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as sx
from ..functions import text as fx
from ..operators import freshness, tables
from ..session import scratch
from ..sources import files as fs
from ..sources.corpus import Corpus, root_of
from .model_sql import model


def _projects(spark, sf_dir):
    return Corpus(spark, sf_dir).files.select("root_path", "adapter_id").distinct()


_PROJECTS = "projects AS (SELECT DISTINCT '/corpus/' || source AS root_path, lang || '-text' AS adapter_id FROM documents)"


def status_counts(spark, sf_dir):
    c = Corpus(spark, sf_dir)
    adapters = c.files.select("doc_id", "adapter_id")
    chunks = c.chunks.select("doc_id", "root_path").join(adapters, "doc_id")
    occurrences = c.words.select("doc_id", "root_path").join(adapters, "doc_id")
    symbols = c.definitions.select("doc_id", "root_path").join(adapters, "doc_id")
    return tables.status_counts(_projects(spark, sf_dir), c.files, symbols, chunks, occurrences)


STATUS_COUNTS = model() + f""", {_PROJECTS}
SELECT root_path, adapter_id,
  (SELECT count(*) FROM files f WHERE f.root_path = p.root_path AND f.adapter_id = p.adapter_id) AS n_files,
  (SELECT count(*) FROM definitions d JOIN files f ON f.doc_id = d.doc_id WHERE f.root_path = p.root_path AND f.adapter_id = p.adapter_id) AS n_symbols,
  (SELECT count(*) FROM chunks c JOIN files f ON f.doc_id = c.doc_id WHERE f.root_path = p.root_path AND f.adapter_id = p.adapter_id) AS n_chunks,
  (SELECT count(*) FROM words w JOIN files f ON f.doc_id = w.doc_id WHERE f.root_path = p.root_path AND f.adapter_id = p.adapter_id) AS n_occurrences
FROM projects p"""


def nation_counts(spark, sf_dir):
    """Counts of two tables by nation, none for those without rows."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customers = read("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    suppliers = read("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    out = read("nation").join(customers, "n_nationkey", "left").join(suppliers, "n_nationkey", "left")
    return out.select("n_name", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))


NATION_COUNTS = """SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers FROM nation"""


def project_scope(spark, sf_dir):
    """Files of the projects of one root, of all adapters."""
    scope = _projects(spark, sf_dir).where(F.col("root_path") == "/corpus/src1")
    files = Corpus(spark, sf_dir).files
    return files.join(scope, ["root_path", "adapter_id"], "left_semi").select("root_path", "adapter_id", "relative_path")


PROJECT_SCOPE = f"WITH {_PROJECTS} SELECT '/corpus/' || source AS root_path, lang || '-text' AS adapter_id, 'd' || doc_id || '.txt' AS relative_path FROM documents WHERE '/corpus/' || source IN (SELECT root_path FROM projects WHERE root_path = '/corpus/src1')"


def prefix_scope(spark, sf_dir):
    """Projects at a root or below it; wildcards in a root's name stand for themselves."""
    rows = _projects(spark, sf_dir).withColumn("root_path", F.regexp_replace("root_path", "src1", "a_b/src1"))
    return rows.where(tables.under(F.col("root_path"), "/corpus/a_b") | tables.under(F.col("root_path"), "/corpus/src2"))


PREFIX_SCOPE = f"""WITH {_PROJECTS}, r AS (SELECT replace(root_path, 'src1', 'a_b/src1') AS root_path, adapter_id FROM projects)
SELECT * FROM r WHERE root_path = '/corpus/a_b' OR root_path LIKE '/corpus/a\\_b/%' ESCAPE '\\' OR root_path = '/corpus/src2' OR root_path LIKE '/corpus/src2/%' ESCAPE '\\'"""


def stale_projects(spark, sf_dir):
    return tables.stale(_projects(spark, sf_dir), "/corpus", ["en-text", "de-text"])


STALE_PROJECTS = f"WITH {_PROJECTS} SELECT * FROM projects WHERE root_path LIKE '/corpus/%' AND adapter_id NOT IN ('en-text', 'de-text')"


def _snapshots(spark, sf_dir):
    """Files as indexed and as they are now: some are new, some gone, some changed."""
    f = Corpus(spark, sf_dir).files.select("doc_id", "relative_path", "text")
    row = lambda df, text: df.select("relative_path", fx.content_hash(text).alias("content_hash"), fx.line_count(text).alias("line_count"))
    indexed = row(f.where("doc_id % 11 <> 3"), F.col("text"))
    changed = F.when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text"))
    return indexed, row(f.where("doc_id % 13 <> 5"), changed)


_SNAPSHOTS = """old AS (SELECT 'd' || doc_id || '.txt' AS relative_path, sha256(text) AS h, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS n FROM documents WHERE doc_id % 11 <> 3
), now0 AS (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN text || chr(10) || 'changed' ELSE text END AS text FROM documents WHERE doc_id % 13 <> 5
), now AS (SELECT 'd' || doc_id || '.txt' AS relative_path, sha256(text) AS h, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS n FROM now0
), pairs AS (SELECT coalesce(o.relative_path, c.relative_path) AS relative_path, o.h AS oh, c.h AS ch, o.n AS onn, c.n AS cn,
  CASE WHEN o.h IS NULL THEN 'new' WHEN c.h IS NULL THEN 'missing' WHEN o.h <> c.h THEN 'dirty' ELSE 'clean' END AS state
  FROM old o FULL JOIN now c ON o.relative_path = c.relative_path)"""


def file_changes(spark, sf_dir):
    return freshness.changes(*_snapshots(spark, sf_dir)).select("relative_path", "state", "changed_lines")


FILE_CHANGES = f"WITH {_SNAPSHOTS} SELECT relative_path, state, CAST(CASE WHEN state = 'clean' THEN 0 ELSE coalesce(cn, onn) END AS INTEGER) AS changed_lines FROM pairs"


def freshness_full(spark, sf_dir):
    out = freshness.freshness(freshness.changes(*_snapshots(spark, sf_dir)))
    return out.withColumn("changed_ratio", F.round("changed_ratio", 9)).withColumn("line_ratio", F.round("line_ratio", 9))


FRESHNESS_FULL = f"""WITH {_SNAPSHOTS}, s AS (SELECT
  sum(CASE WHEN state = 'new' THEN 1 ELSE 0 END)::BIGINT AS n_new, sum(CASE WHEN state = 'missing' THEN 1 ELSE 0 END)::BIGINT AS n_missing,
  sum(CASE WHEN state = 'dirty' THEN 1 ELSE 0 END)::BIGINT AS n_dirty, sum(CASE WHEN state = 'clean' THEN 1 ELSE 0 END)::BIGINT AS n_clean,
  count(oh) AS n_indexed, count(ch) AS n_current, sum(CASE WHEN state = 'clean' THEN 0 ELSE coalesce(cn, onn) END)::BIGINT AS changed_lines, sum(cn)::BIGINT AS total_lines FROM pairs)
SELECT *, round((n_new + n_missing + n_dirty)::DOUBLE / greatest(n_indexed, n_current), 9) AS changed_ratio,
  round(CASE WHEN changed_lines <= 0 THEN 0.0 WHEN total_lines <= 0 THEN 1.0 ELSE least(changed_lines::DOUBLE / total_lines, 1.0) END, 9)::DOUBLE AS line_ratio,
  CASE WHEN changed_lines > 0 THEN 'stale' ELSE 'clean' END AS status FROM s"""


def freshness_diff(spark, sf_dir):
    """Diff rows, of which some are renames in either form, against the paths that matter."""
    docs = Corpus(spark, sf_dir).documents.select("doc_id", "n_chars")
    i = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("src/{old => new}/d"), i, F.lit(".txt"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("gone/d"), i, F.lit(".txt => src/new/d"), i, F.lit(".txt"))).otherwise(F.concat(F.lit("src/new/d"), i, F.lit(".txt")))
    diff = docs.select(path.alias("path"), (F.col("n_chars") % 50).alias("added"), (F.col("n_chars") % 7).alias("deleted"))
    old = F.concat(F.when(F.col("doc_id") % 8 == 0, "src/old/d").otherwise("src/new/d"), i, F.lit(".txt"))
    return freshness.diff_stats(diff, docs.where("doc_id % 3 <> 0").select(old.alias("relative_path")))


FRESHNESS_DIFF = """WITH d AS (SELECT doc_id, n_chars, 'src/old/d' || doc_id || '.txt' AS a, 'src/new/d' || doc_id || '.txt' AS b FROM documents),
r AS (SELECT CASE WHEN doc_id % 8 = 0 THEN a ELSE b END AS relative_path FROM d WHERE doc_id % 3 <> 0),
m AS (SELECT CASE WHEN doc_id % 4 = 0 AND a IN (SELECT relative_path FROM r) THEN a ELSE b END AS relative_path, n_chars % 50 AS added, n_chars % 7 AS deleted FROM d)
SELECT relative_path, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted FROM m WHERE relative_path IN (SELECT relative_path FROM r) GROUP BY relative_path"""


def touched_paths(spark, sf_dir):
    """Changed and untracked paths together, each once, if they matter."""
    f = Corpus(spark, sf_dir).files.select("doc_id", "relative_path")
    return freshness.touched(f.where("doc_id % 3 = 0"), f.where("doc_id % 5 = 0"), f.where("doc_id % 2 = 0"))


TOUCHED_PATHS = "SELECT 'd' || doc_id || '.txt' AS relative_path FROM documents WHERE (doc_id % 3 = 0 OR doc_id % 5 = 0) AND doc_id % 2 = 0"


def reindex_decision(spark, sf_dir):
    """What would be done if so many of an order's lines had been returned."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = items.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("changed"), F.count(F.lit(1)).alias("total"))
    ratio = sx.changed_ratio(F.col("changed"), F.col("total"))
    return rows.select("l_orderkey", freshness.decision(ratio, F.col("changed") > 0).alias("decision"))


REINDEX_DECISION = """WITH r AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS changed, count(*) AS total FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN changed > 0 AND changed::DOUBLE / total >= 0.22 THEN 'reindex' WHEN changed > 0 AND changed::DOUBLE / total >= 0.22 * 2 / 3 THEN 'warn' ELSE 'none' END AS decision FROM r"""


def missing_units(spark, sf_dir):
    projects = _projects(spark, sf_dir)
    detected = projects.where(F.col("adapter_id") != "fr-text").unionByName(projects.select("root_path", F.lit("es2-text").alias("adapter_id")).distinct())
    return freshness.must_reindex(projects, detected)


MISSING_UNITS = f"""WITH {_PROJECTS} SELECT DISTINCT root_path, 'es2-text' AS adapter_id, 'not indexed' AS reason FROM projects
UNION ALL SELECT root_path, adapter_id, 'vanished' FROM projects WHERE adapter_id = 'fr-text'"""


def incremental_merge(spark, sf_dir):
    """Kept rows of unchanged files and new rows of changed ones are what a rebuild gives."""
    files = Corpus(spark, sf_dir).files.select("doc_id", "relative_path", "text")
    now = F.when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text"))
    row = lambda df, text: df.select("relative_path", fx.content_hash(text).alias("content_hash"))
    old, new = row(files, F.col("text")), row(files.where("doc_id % 13 <> 5"), now)
    changed = old.select("relative_path", F.col("content_hash").alias("h")).join(new, "relative_path", "left").where("content_hash IS NULL OR content_hash <> h").select("relative_path")
    return tables.merged(old, new.join(changed, "relative_path", "left_semi"), F.col("relative_path"), changed)


INCREMENTAL_MERGE = "SELECT 'd' || doc_id || '.txt' AS relative_path, sha256(CASE WHEN doc_id % 7 = 1 THEN text || chr(10) || 'changed' ELSE text END) AS content_hash FROM documents WHERE doc_id % 13 <> 5"


def vectors_to_embed(spark, sf_dir):
    """Chunks whose vectors can't be kept, since their text changed or has none."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    old = e.select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("owner_key"), F.concat(F.lit("h"), (F.col("vec_id") % 5).cast("string")).alias("text_hash"), F.col("embedding").alias("vector"))
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("owner_key"), F.concat(F.lit("h"), (F.col("doc_id") % 4).cast("string")).alias("text_hash"))
    return tables.merged_vectors(old, texts)[1]


VECTORS_TO_EMBED = """SELECT 'd' || doc_id AS owner_key, 'h' || (doc_id % 4) AS text_hash FROM documents
WHERE NOT (doc_id % 4 = doc_id % 5 AND doc_id IN (SELECT vec_id FROM embeddings))"""


def full_replace(spark, sf_dir):
    """Written to a store, replaced, and read back with another project beside it."""
    c = Corpus(spark, sf_dir)
    files = c.files.select("root_path", "adapter_id", "relative_path", "abs_path", "language", fx.content_hash(F.col("text")).alias("content_hash"), fx.line_count(F.col("text")).alias("line_count"))
    store = tables.Store(spark, scratch(spark))
    en, de = files.where("language = 'en'"), files.where("language = 'de'")
    store.replace("/corpus", "en-text", {"files": en.limit(3)})
    store.replace("/corpus", "de-text", {"files": de})
    store.replace("/corpus", "en-text", {"files": en})
    return store.table("files").select("root_path", "adapter_id", "relative_path", "content_hash", "line_count")


FULL_REPLACE = """SELECT '/corpus' AS root_path, lang || '-text' AS adapter_id, 'd' || doc_id || '.txt' AS relative_path, sha256(text) AS content_hash,
CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS INTEGER) AS line_count FROM documents WHERE lang IN ('en', 'de')"""


def incremental_store(spark, sf_dir):
    """An update of some files of a project in a store."""
    c = Corpus(spark, sf_dir)
    row = lambda df, text: df.select("relative_path", fx.content_hash(text).alias("content_hash"))
    files = c.files.where("language = 'en'").select("doc_id", "relative_path", "text")
    store = tables.Store(spark, scratch(spark))
    store.replace("/corpus", "en-text", {"files": row(files, F.col("text"))})
    part = files.where("doc_id % 7 = 1")
    store.update("/corpus", "en-text", part.select("relative_path"), {"files": row(part.where("doc_id % 2 = 0"), F.concat("text", F.lit("!")))})
    return store.table("files").select("relative_path", "content_hash")


INCREMENTAL_STORE = "SELECT 'd' || doc_id || '.txt' AS relative_path, sha256(CASE WHEN doc_id % 7 = 1 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE lang = 'en' AND NOT (doc_id % 7 = 1 AND doc_id % 2 = 1)"


def _paths(spark, sf_dir):
    """Pages' URLs as paths, some under directories and names that filters know."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    i = F.col("page_id")
    dirs = F.when(i % 9 == 0, F.concat(F.lit("node_modules/"), bare)).when(i % 9 == 1, F.concat(F.lit("docs/internal/"), bare)).when(i % 9 == 2, F.concat(F.lit("a/testdata/"), bare)).otherwise(bare)
    ends = F.when(i % 5 == 0, ".py").when(i % 5 == 1, ".test.ts").when(i % 5 == 2, ".GO").when(i % 5 == 3, "_pb2.py").otherwise("")
    return pages.select("page_id", F.concat(dirs, ends).alias("relative_path"))


_PATHS = """paths AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'docs/internal/' WHEN 2 THEN 'a/testdata/' ELSE '' END
  || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || CASE page_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.test.ts' WHEN 2 THEN '.GO' WHEN 3 THEN '_pb2.py' ELSE '' END AS relative_path FROM pages)"""


def ignore_filter(spark, sf_dir):
    rules = fs.ignore_rules("# rules\n\nnode_modules/\ndocs/internal\n*_pb2.py\nfr\n")
    return _paths(spark, sf_dir).where(~fs.ignored(F.col("relative_path"), rules))


IGNORE_FILTER = f"""WITH {_PATHS} SELECT * FROM paths WHERE NOT (list_contains(string_split(relative_path, '/'), 'node_modules') OR relative_path = 'docs/internal' OR relative_path LIKE 'docs/internal/%'
  OR ends_with(relative_path, '_pb2.py') OR list_contains(string_split(relative_path, '/'), 'fr'))"""


def extension_filter(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    return paths.where(fs.has_extension(F.col("relative_path"), [".go", ".ts"]) & ~fs.in_directory(F.col("relative_path"), fs.SKIPPED))


EXTENSION_FILTER = f"""WITH {_PATHS} SELECT * FROM paths WHERE lower(regexp_extract(relative_path, '(\\.[^./]*)$', 1)) IN ('.go', '.ts')
  AND len(list_intersect(string_split(relative_path, '/')[:-2], ['node_modules', 'testdata', 'build', 'vendor', 'dist', 'out', 'target'])) = 0"""


def low_value_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", fs.low_value(F.col("relative_path")).alias("low_value"))


LOW_VALUE_PATHS = f"""WITH {_PATHS} SELECT page_id, ends_with(relative_path, '.test.ts') OR ends_with(relative_path, '_pb2.py') OR list_contains(string_split(relative_path, '/'), 'testdata')
  OR starts_with(split_part(relative_path, '/', -1), 'test_') OR ends_with(relative_path, '_test.py') AS low_value FROM paths"""


def source_listing(spark, sf_dir):
    """Files of a language, with their directories, as a listing has them."""
    found = fs.source_files(_paths(spark, sf_dir), "python", fs.ignore_rules("docs/internal\n"))
    return found.select("relative_path", F.array_join(fx.directories(F.col("relative_path")), "/").alias("dir"), fx.base_name(F.col("relative_path")).alias("name"))


SOURCE_LISTING = f"""WITH {_PATHS} SELECT relative_path, array_to_string(string_split(relative_path, '/')[:-2], '/') AS dir, split_part(relative_path, '/', -1) AS name
FROM paths WHERE ends_with(relative_path, '.py') AND NOT relative_path LIKE 'docs/internal/%'"""


def workspace_detection(spark, sf_dir):
    """Units of a tree with manifests, and the nearest one of each file's directory."""
    pages = _paths(spark, sf_dir)
    i = F.col("page_id")
    manifest = F.when(i % 4 == 0, "pyproject.toml").when(i % 4 == 1, "go.mod").when(i % 4 == 2, "setup.py").otherwise("readme.txt")
    first = F.substring_index("relative_path", "/", 1)
    listing = pages.select(F.concat(first, F.lit("/"), manifest).alias("relative_path"))
    found = fs.units(listing)
    paths = pages.select(F.array_join(fx.directories(F.col("relative_path")), "/").alias("path")).distinct()
    return fs.nearest_unit(paths, found)


WORKSPACE_DETECTION = f"""WITH {_PATHS}, l AS (SELECT split_part(relative_path, '/', 1) AS dir, page_id % 4 AS k FROM paths),
u AS (SELECT DISTINCT dir, CASE WHEN k = 1 THEN 'go-scip' ELSE 'python-scip' END AS adapter_id FROM l WHERE k < 3 AND dir <> 'node_modules'),
p AS (SELECT DISTINCT array_to_string(string_split(relative_path, '/')[:-2], '/') AS path FROM paths)
SELECT p.path, u.adapter_id, u.dir FROM p JOIN u ON split_part(p.path, '/', 1) = u.dir"""


def path_resolution(spark, sf_dir):
    """Paths made clean; those that leave the root drop out."""
    paths = _paths(spark, sf_dir)
    i = F.col("page_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit("x/../"), "relative_path")).when(i % 4 == 1, F.concat(F.lit("../"), "relative_path")).when(i % 4 == 2, F.replace("relative_path", F.lit("/"), F.lit("\\"))).otherwise(F.concat(F.lit("./"), F.replace("relative_path", F.lit("/"), F.lit("//"))))
    clean = fx.clean_path(raw)
    return paths.select("page_id", clean.alias("path")).where(fx.inside_root(F.col("path"))).withColumn("shown", fx.display_path(F.concat(F.lit("/root/"), "path"), "/root"))


PATH_RESOLUTION = f"WITH {_PATHS} SELECT page_id, relative_path AS path, './' || relative_path AS shown FROM paths WHERE page_id % 4 <> 1"


def display_name(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = F.regexp_replace("url", "[?].*$", "()")
    return pages.select("page_id", fx.display_name(url).alias("name"), fx.display_name(url, python=True).alias("python_name"), fx.unit_name(F.regexp_replace("url", "/", " "), "project").alias("unit"), fx.artifact_suffix(F.col("url")).alias("suffix"))


DISPLAY_NAME = """WITH u AS (SELECT page_id, url, regexp_replace(url, '[?].*$', '()') AS s FROM pages),
a AS (SELECT *, split_part(rtrim(s, '.#:/!'), '/', -1) AS n FROM u),
b AS (SELECT *, trim(split_part(regexp_replace(regexp_replace(n, '\\)\\.$', ''), '\\(\\)$', ''), '(', 1), '`') AS py,
  trim(split_part(regexp_replace(regexp_replace(split_part(n, ':', -1), '\\)\\.$', ''), '\\(\\)$', ''), '(', 1), '`') AS go FROM a)
SELECT page_id, CASE WHEN regexp_matches(go, '[#.][^#.]+$') THEN regexp_extract(go, '([^#.]+)$', 1) WHEN go <> '' THEN go ELSE s END AS name,
  CASE WHEN py <> '' THEN py ELSE s END AS python_name, replace(trim(replace(url, '/', ' ')), ' ', '-') AS unit,
  trim(regexp_replace(lower(url), '[^a-z0-9]', '_', 'g'), '_') AS suffix FROM b"""


def kind_label(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in ("function_definition", "func_declaration", "var_declaration", "impl_item", "import_from_statement", "", "class_declaration", "mod_item", "TYPE_alias")], "kind string")
    enums = F.when(F.char_length("kind") % 2 == 0, F.lit("SyntaxKind_IdentifierFunctionKind")).otherwise(F.lit("UnspecifiedKind"))
    return kinds.select("kind", fx.kind_label(F.col("kind")).alias("label"), fx.enum_label(enums, "SyntaxKind_", "Kind").alias("enum"))


KIND_LABEL = """SELECT kind, label, CASE WHEN length(kind) % 2 = 0 THEN 'identifier_function' ELSE '' END AS enum FROM (VALUES ('function_definition', 'Function'), ('func_declaration', 'Function'), ('var_declaration', 'Variable'),
  ('impl_item', 'Implementation'), ('import_from_statement', 'Import From Statement'), ('', 'Result'), ('class_declaration', 'Class'), ('mod_item', 'Mod'), ('TYPE_alias', 'Type Alias')) AS t(kind, label)"""


def code_preview(spark, sf_dir):
    """Previews of pages and short forms of documents; only ASCII is cut in bytes here."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ascii_only = F.regexp_replace("html", "[^\\x00-\\x7F]", "?")
    return pages.select("page_id", fx.code_preview(ascii_only, 100).alias("preview"), fx.header_text(ascii_only).alias("header"))


CODE_PREVIEW = """WITH p AS (SELECT page_id, regexp_replace(html, '[^\\x00-\\x7F]', '?', 'g') AS h FROM pages),
l AS (SELECT *, trim(split_part(trim(h, ' ' || chr(9) || chr(13) || chr(10)), chr(10), 1), ' ' || chr(9) || chr(13) || chr(10)) AS line FROM p),
c AS (SELECT *, CASE WHEN contains(line, '{') THEN trim(regexp_replace(split_part(line, '{', 1), ';$', ''), ' ' || chr(9) || chr(13)) ELSE line END AS cut FROM l)
SELECT page_id, CASE WHEN length(cut) > 100 THEN trim(left(cut, 100), ' ' || chr(9) || chr(13)) || '...' ELSE cut END AS preview, left(trim(split_part(h, chr(10), 1), ' ' || chr(9) || chr(13)), 160) AS header FROM c"""


def doc_flatten(spark, sf_dir):
    docs = Corpus(spark, sf_dir).documents
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```py\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return docs.select("doc_id", F.sha2(fx.flatten_doc(text), 256).alias("flat"), F.sha2(fx.strip_code_fences(text), 256).alias("stripped"))


DOC_FLATTEN = """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\r\\n\\x0B\\f]+', ' ', 'g'))) AS flat,
  sha256(array_to_string(list_filter(list_transform(ls, x -> trim(x, ' ' || chr(9) || chr(13))), x -> x <> '' AND NOT starts_with(x, '```')), ' ')) AS stripped FROM d"""


def truncated_lines(spark, sf_dir):
    docs = Corpus(spark, sf_dir).documents
    return docs.select("doc_id", fx.truncate_lines(F.col("text"), 3).alias("text"), fx.thousands(F.col("n_chars")).alias("n_chars"))


TRUNCATED_LINES = """WITH d AS (SELECT doc_id, text, n_chars, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, CASE WHEN len(ls) > 3 THEN array_to_string(ls[1:3], chr(10)) || chr(10) || chr(10) || '... (' || (len(ls) - 3) || ' lines left out)' ELSE text END AS text, format('{:,}', n_chars) AS n_chars FROM d"""


def root_vote(spark, sf_dir):
    return fs.voted_root(_projects(spark, sf_dir).select(F.col("root_path").alias("root"))).select("root", "n")


ROOT_VOTE = f"WITH {_PROJECTS} SELECT root_path AS root, count(*) AS n FROM projects GROUP BY root_path ORDER BY n DESC, length(root_path) DESC, root_path LIMIT 1"


def run_log(spark, sf_dir):
    """Events as runs in a store's log, by day, with times as the log writes them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    store = tables.Store(spark, scratch(spark))
    store.log_run("/corpus", "events", e.select(F.col("ts").alias("started_at"), F.col("ts").alias("completed_at"), F.col("event_type").alias("status")))
    runs = store.table("index_runs").groupBy(F.to_date("started_at").alias("day"), "status")
    out = runs.agg(F.count(F.lit(1)).alias("runs"), F.min("started_at").alias("first"), F.max("completed_at").alias("last"))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "status", "runs", fx.rfc3339(F.col("first")).alias("started_at"), fx.rfc3339(F.col("last")).alias("completed_at"))


RUN_LOG = """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type AS status, count(*) AS runs, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS started_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS completed_at FROM events GROUP BY CAST(ts AS DATE), event_type"""


def indexed_files(spark, sf_dir):
    """Files of a root as a store has them."""
    c = Corpus(spark, sf_dir, "src2")
    store = tables.Store(spark, scratch(spark))
    store.replace(root_of("src2"), "text", {"files": c.files.select("relative_path", fx.content_hash(F.col("text")).alias("content_hash"), fx.line_count(F.col("text")).alias("line_count"))})
    return store.table("files").where(F.col("root_path") == root_of("src2")).select("relative_path", "content_hash", "line_count")


INDEXED_FILES = """SELECT 'd' || doc_id || '.txt' AS relative_path, sha256(text) AS content_hash,
CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS INTEGER) AS line_count FROM documents WHERE source = 'src2'"""


def indexed_chunks(spark, sf_dir):
    """Chunks with their symbols and parents' names, empty where there are none."""
    from ..operators import derive

    c = Corpus(spark, sf_dir, "src2")
    primary = derive.primary_symbols(c.chunks, c.definitions)
    parents = derive.parents(derive.chunk_spans(c))
    rows = c.chunks.join(primary, "chunk_key", "left").join(parents, "chunk_key", "left")
    outer = c.chunks.select(F.col("chunk_key").alias("parent_key"), F.col("name").alias("parent_name"))
    rows = rows.join(outer, "parent_key", "left")
    return rows.select("chunk_key", "kind", F.coalesce("primary_symbol", F.lit("")).alias("symbol"), F.coalesce("parent_name", F.lit("")).alias("parent_name"))


INDEXED_CHUNKS = model("src2") + """, offsets AS (
  SELECT doc_id, line, strlen(line_text) AS size, coalesce(sum(strlen(line_text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM lines
), spans AS (
  SELECT c.doc_id, c.chunk_key, c.name, a.ahead AS sb, b.ahead + b.size AS eb FROM chunks c JOIN offsets a ON a.doc_id = c.doc_id AND a.line = c.start_line JOIN offsets b ON b.doc_id = c.doc_id AND b.line = c.end_line
), pairs AS (
  SELECT i.chunk_key, o.name AS parent_name, row_number() OVER (PARTITION BY i.chunk_key ORDER BY o.eb - o.sb, o.sb, -o.eb, o.chunk_key) AS rn
  FROM spans i JOIN spans o ON i.doc_id = o.doc_id AND o.eb > o.sb AND o.chunk_key <> i.chunk_key AND o.sb <= i.sb AND o.eb >= i.eb
)
SELECT c.chunk_key, c.kind, coalesce(c.primary_symbol, '') AS symbol, coalesce(p.parent_name, '') AS parent_name FROM pchunks c LEFT JOIN pairs p ON p.chunk_key = c.chunk_key AND p.rn = 1"""


def indexed_vectors(spark, sf_dir):
    """Vectors of the module chunks of a root, as a store has them."""
    c = Corpus(spark, sf_dir, "src2")
    modules = c.chunks.where("kind = 'module'").select(F.col("chunk_key").alias("owner_key"), F.col("doc_id").alias("vec_id"))
    store = tables.Store(spark, scratch(spark))
    vectors = modules.join(c.vectors, "vec_id").select(F.lit("chunk").alias("owner_type"), "owner_key", F.col("embedding").alias("vector"))
    store.replace(root_of("src2"), "text", {"embeddings": vectors})
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 5)
    return store.table("embeddings").select(F.col("owner_key").alias("chunk_key"), total.alias("total"), F.size("vector").alias("n"))


INDEXED_VECTORS = model("src2") + "\nSELECT c.chunk_key, round(list_sum(CAST(e.embedding AS DOUBLE[])), 5) AS total, CAST(len(e.embedding) AS INTEGER) AS n FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id WHERE c.kind = 'module'"


def index_totals(spark, sf_dir):
    return status_counts(spark, sf_dir).agg(F.sum("n_files").alias("n_files"), F.sum("n_symbols").alias("n_symbols"), F.sum("n_chunks").alias("n_chunks"), F.count(F.lit(1)).alias("n_projects"))


INDEX_TOTALS = model() + f", {_PROJECTS}\nSELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM definitions) AS n_symbols, (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(*) FROM projects) AS n_projects"


def existence(spark, sf_dir):
    projects = _projects(spark, sf_dir)
    rows = [(root, tables.exists(projects.where(F.col("root_path") == root))) for root in ("/corpus/src0", "/corpus/none")]
    return spark.createDataFrame(rows, "root_path string, is_indexed boolean")


EXISTENCE = f"WITH {_PROJECTS} SELECT r AS root_path, EXISTS (SELECT 1 FROM projects WHERE root_path = r) AS is_indexed FROM (VALUES ('/corpus/src0'), ('/corpus/none')) t(r)"


def sampled_rows(spark, sf_dir):
    """The first and last few orders of each status, as a summary shows them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return tables.ends(orders, ["o_orderstatus"], "o_orderdate", "o_orderkey", 3).select("o_orderstatus", "o_orderkey", "a")


SAMPLED_ROWS = """SELECT o_orderstatus, o_orderkey, CAST(a AS INTEGER) AS a FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS z FROM orders) WHERE a <= 3 OR z <= 3"""

QUERIES = {
    f.__name__: f
    for f in (
        status_counts, nation_counts, project_scope, prefix_scope, stale_projects, file_changes, freshness_full, freshness_diff, touched_paths, reindex_decision,
        missing_units, incremental_merge, vectors_to_embed, full_replace, incremental_store, ignore_filter, extension_filter, low_value_paths, source_listing,
        workspace_detection, path_resolution, display_name, kind_label, code_preview, doc_flatten, truncated_lines, root_vote, run_log, indexed_files,
        indexed_chunks, indexed_vectors, index_totals, existence, sampled_rows,
    )
}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
