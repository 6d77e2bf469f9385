"""Reference graph, interval and secret queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import graph, intervals, secrets
from gleaner.runtime import stored, table


def _graph(spark, sf_dir):
    """Suppliers define the orders they serve, customers refer to the orders they placed."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit("order-"), F.col(c).cast("string"))
    defs = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("file"), name("l_orderkey").alias("name")).distinct()
    refs = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.concat(F.lit("c"), "o_custkey").alias("file"), name("o_orderkey").alias("name"))
    nodes = defs.select(F.col("file").alias("node")).union(refs.select("file")).distinct()
    return defs, refs, nodes


def _edges(spark, sf_dir):
    defs, refs, nodes = _graph(spark, sf_dir)
    return stored(graph.build_edges(defs, refs, nodes.count()), "edges"), nodes


def d5_edges(spark, sf_dir):
    e, _ = _edges(spark, sf_dir)
    return e.select("src", "dst", "weight", F.round("scaled", 6).alias("scaled"), F.array_join("via", " ").alias("via"))


def d5_pagerank(spark, sf_dir):
    e, nodes = _edges(spark, sf_dir)
    return graph.pagerank(nodes, e.select("src", "dst", "scaled")).select("node", F.round("rank", 8).alias("rank"))


def d6_neighbours(spark, sf_dir):
    """The neighbours of every supplier."""
    e, nodes = _edges(spark, sf_dir)
    n = graph.neighbours(e, nodes.where("node like 's%'"))
    return n.select("node", "rank", "other", "dir", "weight", F.array_join("via", " ").alias("via"))


def d14_hunks(spark, sf_dir):
    """Line items as hunks of their order, kept where they overlap a range that the order's customer gives."""
    hunks = intervals.with_ends(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 20).alias("new_start"), F.col("l_quantity").cast("int").alias("new_count")))
    ranges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 100).alias("a"), (F.col("o_custkey") % 100 + 10).alias("b"))
    return intervals.overlapping(hunks, ranges, "l_orderkey", ("new_start", "new_end"), ("a", "b")).select("l_orderkey", "l_linenumber", "new_start", "new_end")


#: A settings file for every customer, with a line of one of the kinds that are secrets, or of two that are not; in SQL that both engines read.
_SETTINGS = """concat('# settings of ', c_name, chr(10), case c_custkey % 18
  when 0 then concat('aws = AKIA', lpad(cast(c_custkey as varchar(20)), 16, 'Z')) when 1 then concat('my-api_key-x: ', c_custkey) when 2 then concat('token ghp_', repeat('a1', 18)) when 3 then concat('github_pat_', repeat('b', 22), '_', repeat('c', 59))
  when 4 then concat('xoxb-1234567890-', '12345678901', c_custkey) when 5 then concat('sk-', repeat('d', 48)) when 6 then concat('sk-proj-', repeat('e', 80)) when 7 then 'DB_PASSWORD=hunter' when 8 then 'client_secret : q' when 9 then 'private-key = r'
  when 10 then 'url postgres://u:p@h' when 11 then 'mongodb+srv://u:p@h' when 12 then 'AZURE_STORAGE_KEY' when 13 then 'AWS_SECRET_ACCESS' when 14 then '-----BEGIN RSA PRIVATE KEY-----' when 15 then 'Authorization: Basic abc' when 16 then 'passwordless login' else 'keyboard' end, chr(10))"""


def d12_secrets(spark, sf_dir):
    """Lines with a secret in all notes, documents and packet files, and in a settings file for every customer."""
    made = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey", F.lit("/settings")).alias("path"), F.expr(_SETTINGS).alias("text"))
    notes = table(spark, sf_dir, "notes").select("path", "text")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), "text")
    files = table(spark, sf_dir, "packet_files").select(F.col("file_path").alias("path"), F.col("payload").alias("text"))
    return secrets.scan(notes.unionByName(docs).unionByName(files).unionByName(made), "path", "text")


def d12_sensitive_paths(spark, sf_dir):
    """All paths, with whether the file name is a sensitive one."""
    paths = table(spark, sf_dir, "notes").select("path").union(table(spark, sf_dir, "packet_files").select("file_path")).where("path is not null").distinct()
    made = paths.union(paths.select(F.regexp_replace("path", r"\.md$", ".log"))).distinct()
    return made.select("path", secrets.is_sensitive_path(F.col("path")).alias("sensitive"))


_G = """
with defs as (select distinct 's' || l_suppkey file, 'order-' || l_orderkey as name from lineitem),
refs as (select 'c' || o_custkey file, 'order-' || o_orderkey as name from lineitem join orders on l_orderkey = o_orderkey),
nodes as (select file node from defs union select file from refs),
deg as (select name, count(*) degree from defs where length(name) >= 3 group by 1 having count(*) <= 20),
cnt as (select file, name, count(*) cnt from refs group by 1, 2),
spread as (select name, count(*) files from cnt group by 1 having count(*) <= (select greatest(12, floor(0.02 * count(*))) from nodes)),
edges as (
  select c.file src, d.file dst, sum(cnt)::bigint weight, sum(sqrt(cnt) / degree * greatest(0.1, ln((select count(*) from nodes)::double / (1 + files)))) scaled,
         array_to_string(list_sort(list(distinct name))[1:5], ' ') via
  from cnt c join deg using (name) join spread using (name) join defs d using (name) where c.file <> d.file group by 1, 2
)"""


def _rank_sql(rounds: int = 40) -> str:
    parts = [_G, """, o as (select src, sum(scaled) total from edges group by 1 having sum(scaled) > 0), l as materialized (select src, dst, scaled / total share from edges join o using (src)),
      n as (select count(*)::double n from nodes), r0 as materialized (select node, 1 / n.n as rank from nodes, n)"""]
    for k in range(1, rounds + 1):
        p = k - 1
        parts.append(f""", r{k} as materialized (select node, 0.15 / n.n + 0.85 * (coalesce(g.got, 0) + (select coalesce(sum(rank), 0) from r{p} where node not in (select src from o)) / n.n) as rank
          from nodes cross join n left join (select dst, sum(rank * share) got from l join r{p} on l.src = r{p}.node group by 1) g on g.dst = node)""")
    return "".join(parts) + f" select node, round(rank, 8) as rank from r{rounds}"


_PATTERN = (
    r"(?i)AKIA[0-9A-Z]{16}|[\w-]*api[_-]?key[\w-]*\s*[:=]|[\w-]*apikey[\w-]*\s*[:=]|gh[pous]_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9]{22}_[a-zA-Z0-9]{59}|xox[baprs]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*"
    r"|sk-[a-zA-Z0-9]{48}|sk-proj-[\w-]{80,}|[\w-]*password[\w-]*\s*[:=]|[\w-]*secret[\w-]*\s*[:=]|[\w-]*private[_-]?key[\w-]*\s*[:=]|(postgres|mysql|redis|mongodb|mongodb\+srv)://[^:]+:[^@]+@"
    r"|AZURE[_-]?[A-Z_]*[_-]?(KEY|SECRET|TOKEN|PASSWORD)|[\w-]*AWS[_-]?SECRET[\w-]*|-----BEGIN (RSA |DSA |EC |OPENSSH |PGP )?PRIVATE KEY-----|-----BEGIN CERTIFICATE-----|bearer\s+[\w\-.]+|authorization:\s*(bearer|basic)\s+[\w\-.]+"
)
SQL = {
    "d5_edges": _G + " select src, dst, weight, round(scaled, 6) as scaled, via from edges",
    "d5_pagerank": _rank_sql(),
    "d6_neighbours": _G + """, b as (select dst node, src other, 'in' dir, weight, via from edges where dst like 's%' union all select src, dst, 'out', weight, via from edges where src like 's%')
      select node, row_number() over (partition by node order by weight desc, other) as rank, other, dir, weight, via from b""",
    "d14_hunks": """with h as (select l_orderkey, l_linenumber, l_linenumber * 20 as new_start, greatest(l_linenumber * 20, l_linenumber * 20 + l_quantity::int - 1) as new_end from lineitem)
      select h.* from h where exists (select 1 from orders o where o.o_orderkey = h.l_orderkey and h.new_start <= o.o_custkey % 100 + 10 and o.o_custkey % 100 <= h.new_end)""",
    "d12_secrets": f"""with f as (select path, text from notes union all select 'd' || doc_id, text from documents union all select file_path, payload from packet_files union all select 'c' || c_custkey || '/settings', {_SETTINGS} from customer),
      l as (select path, unnest(string_split_regex(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n')) line, generate_subscripts(string_split_regex(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n'), 1) line_no from f where text is not null and text <> '' and strlen(text) <= 2000000)
      select distinct path, line_no::int as line_no, trim(line) as line from l where regexp_matches(line, '{_PATTERN}')""",
    "d12_sensitive_paths": f"""with p as (select path from notes where path is not null union select file_path from packet_files), q as (select path from p union select regexp_replace(path, '\\.md$', '.log') from p),
      b as (select path, regexp_extract(path, '[^/]*$') base from q)
      select path, base in ('.npmrc', '.pypirc', '.netrc', '.htpasswd', 'credentials', 'secrets.json', 'secrets.yml', 'secrets.yaml', 'config.json', 'config.yml', 'id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519')
        or regexp_matches(base, '^\\.env|\\.(pem|key|p12|pfx|jks|log)$') as sensitive from b""",
}
QUERIES = {f.__name__: f for f in (d5_edges, d5_pagerank, d6_neighbours, d14_hunks, d12_secrets, d12_sensitive_paths)}
