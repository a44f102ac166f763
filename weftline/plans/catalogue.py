"""Scripts over the test tables, each with SQL that gives the same rows and columns.

Every query reads its whole tables. Sums of money are rounded where the order of addition could show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans.engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Name, script, SQL.
CATALOGUE: list[tuple[str, str, str]] = [
    (
        "filter_project",
        "lineitem[*] | where l => l.l_quantity > 45 | select l => { k: l.l_orderkey, q: l.l_quantity }",
        "SELECT l_orderkey k, l_quantity q FROM lineitem WHERE l_quantity>45",
    ),
    (
        "topk_revenue",
        'lineitem[*] | where l => l.l_quantity > 30 && l.l_returnflag == "R" | select l => { key: l.l_orderkey, revenue: l.l_extendedprice * (1 - l.l_discount) } | orderBy r => r.revenue desc, r => r.key | take 10',
        "SELECT l_orderkey AS key, l_extendedprice*(1-l_discount) AS revenue FROM lineitem WHERE l_quantity>30 AND l_returnflag='R' ORDER BY revenue DESC, key LIMIT 10",
    ),
    (
        "skip_take",
        "customer[*] | orderBy c => c.c_custkey | skip 20 | take 5 | select c => { k: c.c_custkey }",
        "SELECT c_custkey k FROM customer ORDER BY 1 LIMIT 5 OFFSET 20",
    ),
    (
        "distinct_values",
        "orders[*] | select o => o.o_orderpriority | distinct",
        "SELECT DISTINCT o_orderpriority AS value FROM orders",
    ),
    (
        "group_pricing",
        "lineitem[*] | groupBy l => { f: l.l_returnflag, s: l.l_linestatus } | select g => { flag: g.key.f, status: g.key.s, n: (g.items | count), qty: (g.items | select i => i.l_quantity | sum) }",
        "SELECT l_returnflag flag,l_linestatus status,count(*) n,sum(l_quantity) qty FROM lineitem GROUP BY 1,2",
    ),
    (
        "group_filtered_agg",
        'orders[*] | groupBy o => o.o_orderstatus | select g => { status: g.key, urgent: (g.items | where i => i.o_orderpriority == "1-URGENT" | count), hi: (g.items | select i => i.o_totalprice | max) }',
        "SELECT o_orderstatus status, count(*) FILTER (o_orderpriority='1-URGENT') urgent, max(o_totalprice) hi FROM orders GROUP BY 1",
    ),
    (
        "having",
        "customer[*] | groupBy c => c.c_nationkey | select g => { nation: g.key, n: (g.items | count) } | where r => r.n > 5",
        "SELECT c_nationkey nation,count(*) n FROM customer GROUP BY 1 HAVING count(*)>5",
    ),
    (
        "group_items_concat",
        'nation[*] | groupBy n => n.n_regionkey | select g => { r: g.key, names: (g.items | orderBy i => i.n_name | select i => i.n_name | concat(",")) }',
        """SELECT n_regionkey r, string_agg(n_name, ',' ORDER BY n_name) "names" FROM nation GROUP BY 1""",
    ),
    (
        "scalar_sum",
        "{ total: (lineitem[*] | select l => l.l_quantity | sum) }",
        "SELECT sum(l_quantity) total FROM lineitem",
    ),
    (
        "quantifiers",
        "{ anyNeg: (supplier[*] | any s => s.s_acctbal < 0), allPos: (part[*] | all p => p.p_retailprice > 0) }",
        'SELECT (SELECT coalesce(bool_or(s_acctbal<0),false) FROM supplier) "anyNeg", (SELECT coalesce(bool_and(p_retailprice>0),true) FROM part) "allPos"',
    ),
    (
        "first_pred",
        "{ k: (part[*] | orderBy p => p.p_partkey | first p => p.p_size > 40).p_partkey }",
        "SELECT min(p_partkey) k FROM part WHERE p_size>40",
    ),
    (
        "join_inner",
        "orders[*] | join customer on o => o.o_custkey equals c => c.c_custkey into c | select r => { k: r.o_orderkey, seg: r.c.c_mktsegment }",
        "SELECT o_orderkey k, c_mktsegment seg FROM orders JOIN customer ON o_custkey IS NOT DISTINCT FROM c_custkey",
    ),
    (
        "join_left",
        "customer[*] | join orders on c => c.c_custkey equals o => o.o_custkey into o left | select r => { c: r.c_custkey, o: r.o.o_orderkey }",
        "SELECT c_custkey c,o_orderkey o FROM customer LEFT JOIN orders ON c_custkey=o_custkey",
    ),
    (
        "join_right",
        "nation[*] | where n => n.n_regionkey < 2 | join region on n => n.n_regionkey equals r => r.r_regionkey into r right | select x => { n: x.n_name, r: x.r.r_name }",
        "SELECT n_name n,r_name r FROM (SELECT * FROM nation WHERE n_regionkey<2) RIGHT JOIN region ON n_regionkey=r_regionkey",
    ),
    (
        "join_full",
        "supplier[*] | join nation on s => s.s_nationkey equals n => n.n_nationkey into n full | select x => { s: x.s_name, n: x.n.n_name }",
        "SELECT s_name s,n_name n FROM supplier FULL JOIN nation ON s_nationkey=n_nationkey",
    ),
    (
        "join_no_alias",
        "nation[*] | join region on n => n.n_regionkey equals r => r.r_regionkey | select x => { n: x.n_name, r: x.r_name }",
        "SELECT n_name n,r_name r FROM nation JOIN region ON n_regionkey=r_regionkey",
    ),
    (
        "three_way_agg",
        "customer[*] | join orders on c => c.c_custkey equals o => o.o_custkey | join nation on x => x.c_nationkey equals n => n.n_nationkey | groupBy x => x.n_name | select g => { n: g.key, t: (g.items | select i => i.o_totalprice | sum).round(1) }",
        "SELECT n_name n,round(sum(o_totalprice),1) t FROM customer JOIN orders ON c_custkey=o_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1",
    ),
    (
        "semi_in",
        """let big = orders[*] | where o => o.o_totalprice > 200000 | select o => o.o_custkey 
customer[*] | where c => c.c_custkey.in(big) | select c => { k: c.c_custkey }""",
        "SELECT c_custkey k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice>200000)",
    ),
    (
        "anti_in",
        "customer[*] | where c => !c.c_custkey.in(orders[*] | where o => o.o_totalprice > 200000 | select o => o.o_custkey) | select c => { k: c.c_custkey }",
        "SELECT c_custkey k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice>200000 AND o_custkey IS NOT DISTINCT FROM c_custkey)",
    ),
    (
        "memo_lookup",
        """let nm = memo k => nation[*] | first n => n.n_nationkey == k 
supplier[*] | select s => { s: s.s_suppkey, n: nm(s.s_nationkey).n_name }""",
        "SELECT s_suppkey s, n_name n FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey",
    ),
    (
        "correlated_count",
        "region[*] | select r => { r: r.r_name, n: (nation[*] | where n => n.n_regionkey == r.r_regionkey | count) }",
        "SELECT r_name r, (SELECT count(*) FROM nation WHERE n_regionkey=r_regionkey) n FROM region",
    ),
    (
        "match_case",
        'orders[*] | select o => { k: o.o_orderkey, s: o.o_orderstatus | match "F" => "done", "O" => "open", _ => "other" }',
        "SELECT o_orderkey k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END s FROM orders",
    ),
    (
        "if_else",
        'part[*] | select p => { k: p.p_partkey, b: if p.p_size > 25 then "L" else "S" }',
        "SELECT p_partkey k, CASE WHEN p_size>25 THEN 'L' ELSE 'S' END b FROM part",
    ),
    (
        "let_chain",
        "lineitem[*] | select l => let net = l.l_extendedprice * (1 - l.l_discount) let gross = net * (1 + l.l_tax) { k: l.l_orderkey, g: gross }",
        "SELECT l_orderkey k, l_extendedprice*(1-l_discount)*(1+l_tax) g FROM lineitem",
    ),
    (
        "interpolate",
        "nation[*] | select n => { t: `{n.n_name}/{n.n_regionkey}` }",
        "SELECT n_name || '/' || n_regionkey t FROM nation",
    ),
    (
        "string_case",
        "part[*] | select p => { k: p.p_partkey, u: p.p_name.toUpper(), f: p.p_name.toUpper(1), l: p.p_brand.toLower() }",
        "SELECT p_partkey k, upper(p_name) u, upper(p_name[1])||p_name[2:] f, lower(p_brand) l FROM part",
    ),
    (
        "string_pad_slice",
        'part[*] | select p => { k: p.p_partkey, l: p.p_name.left(3), r: p.p_name.right(3), s: p.p_name.substring(1, 3), z: p.p_size.toString().padLeft(4, "0") }',
        "SELECT p_partkey k, left(p_name,3) l, right(p_name,3) r, substr(p_name,2,3) s, lpad(p_size::varchar,4,'0') z FROM part",
    ),
    (
        "string_search_ci",
        'part[*] | where p => p.p_name.contains("WIDGET") | select p => { k: p.p_partkey }',
        "SELECT p_partkey k FROM part WHERE contains(lower(p_name),'widget')",
    ),
    (
        "string_replace_split",
        'orders[*] | select o => { k: o.o_orderkey, p: o.o_orderpriority.split("-")[1], r: o.o_orderpriority.replace("-", "_") }',
        "SELECT o_orderkey k, split_part(o_orderpriority,'-',2) p, replace(o_orderpriority,'-','_') r FROM orders",
    ),
    (
        "regex_hits",
        'pages[*] | select p => { k: p.page_id, n: p.html.regex("<a ").count() }',
        "SELECT page_id k, len(regexp_extract_all(html,'<a ')) n FROM pages",
    ),
    (
        "hash_md5",
        "customer[*] | select c => { k: c.c_custkey, h: c.c_name.hash(8) }",
        "SELECT c_custkey k, left(md5(c_name),8) h FROM customer",
    ),
    (
        "round_modes",
        "lineitem[*] | select l => { k: l.l_orderkey, a: l.l_extendedprice.round(), f: l.l_extendedprice.floor(), c: l.l_extendedprice.ceiling() }",
        "SELECT l_orderkey k, round(l_extendedprice) a, floor(l_extendedprice) f, ceil(l_extendedprice) c FROM lineitem",
    ),
    (
        "convert",
        'part[*] | select p => { k: p.p_partkey, n: p.p_brand.split("#")[1].toNumber(), b: p.p_size.convertTo("Boolean") }',
        "SELECT p_partkey k, CAST(split_part(p_brand,'#',2) AS DOUBLE) n, p_size<>0 b FROM part",
    ),
    (
        "null_fallback",
        'customer[*] | join orders on c => c.c_custkey equals o => o.o_custkey into o left | select r => { c: r.c_custkey, s: r.o.o_orderstatus.isNullOrEmpty("none") }',
        "SELECT c_custkey c, coalesce(nullif(o_orderstatus,''),'none') s FROM customer LEFT JOIN orders ON c_custkey=o_custkey",
    ),
    (
        "parse_json_col",
        'events[*] | select e => { id: e.event_id, k: e.props.parseJson().k.convertTo("Int64") }',
        "SELECT event_id id, CAST(json_extract(props,'$.k') AS BIGINT) k FROM events",
    ),
    (
        "date_group",
        'orders[*] | groupBy o => o.o_orderdate.dateFormat("yyyy-MM") | select g => { m: g.key, n: (g.items | count) }',
        "SELECT strftime(o_orderdate,'%Y-%m') m, count(*) n FROM orders GROUP BY 1",
    ),
    (
        "date_add",
        'orders[*] | select o => { k: o.o_orderkey, d: o.o_orderdate.add("1.06:30:00").dateFormat("yyyy-MM-dd HH:mm:ss") }',
        "SELECT o_orderkey k, strftime(o_orderdate + INTERVAL 1 DAY + INTERVAL 6 HOUR + INTERVAL 30 MINUTE,'%Y-%m-%d %H:%M:%S') d FROM orders",
    ),
    (
        "unix_seconds",
        "events[*] | select e => { id: e.event_id, s: e.ts.toUnixTimeSeconds() }",
        "SELECT event_id id, CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) s FROM events",
    ),
    (
        "select_many",
        "embeddings[*] | selectMany v => v.embedding | count",
        "SELECT count(*) AS value FROM (SELECT unnest(embedding) FROM embeddings)",
    ),
    (
        "array_fold",
        "embeddings[*] | select v => { id: v.vec_id, s: (v.embedding | reduce (a, x) => a + x from 0).round(3) }",
        "SELECT vec_id id, round(list_sum(embedding::DOUBLE[]),3) s FROM embeddings",
    ),
    (
        "array_any_slice",
        "embeddings[*] | select v => { id: v.vec_id, pos: (v.embedding | any x => x > 0.3), n: v.embedding.take(3) | count }",
        "SELECT vec_id id, len(list_filter(embedding, lambda x: x>0.3))>0 pos, len(embedding[1:3]) n FROM embeddings",
    ),
    (
        "take_while",
        "customer[*] | orderBy c => c.c_custkey | takeWhile c => c.c_custkey < 10 | select c => { k: c.c_custkey }",
        "SELECT c_custkey k FROM customer WHERE c_custkey<10",
    ),
    (
        "batch_rows",
        "nation[*] | orderBy n => n.n_nationkey | batch 10 | select b => { first: (b | first).n_nationkey, n: (b | count) }",
        'SELECT min(n_nationkey) "first", count(*) n FROM (SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey)-1)//10 g FROM nation) GROUP BY g',
    ),
    (
        "index_rows",
        "nation[*] | index",
        "SELECT row_number() OVER ()-1 AS value FROM nation",
    ),
    (
        "union_spread",
        "[...(nation[*] | select n => n.n_name), ...(region[*] | select r => r.r_name)]",
        "SELECT n_name AS value FROM nation UNION ALL SELECT r_name FROM region",
    ),
    (
        "object_ops",
        'customer[*] | select c => c.keep("c_custkey", "c_name")',
        "SELECT c_custkey,c_name FROM customer",
    ),
    (
        "object_spread",
        "nation[*] | select n => { ...n, up: n.n_name.toUpper() }",
        "SELECT *, upper(n_name) up FROM nation",
    ),
    (
        "multi_turn",
        'conversations[*] | groupBy c => c.conv_id | select g => { id: g.key, roles: (g.items | orderBy i => i.turn | select i => i.role | concat(">")) }',
        "SELECT conv_id id, string_agg(role,'>' ORDER BY turn) roles FROM conversations GROUP BY 1",
    ),
    (
        "pricing_summary",
        'lineitem[*] | where l => l.l_shipdate <= "1998-09-02" | groupBy l => { f: l.l_returnflag, s: l.l_linestatus } | select g => { flag: g.key.f, status: g.key.s, qty: (g.items | select i => i.l_quantity | sum), base: (g.items | select i => i.l_extendedprice | sum).round(0), disc: (g.items | select i => i.l_extendedprice * (1 - i.l_discount) | sum).round(0), n: (g.items | count) }',
        "SELECT l_returnflag flag, l_linestatus status, sum(l_quantity) qty, round(sum(l_extendedprice),0) base, round(sum(l_extendedprice*(1-l_discount)),0) disc, count(*) n FROM lineitem WHERE l_shipdate<=TIMESTAMP '1998-09-02' GROUP BY 1,2",
    ),
    (
        "group_quantifiers",
        'orders[*] | groupBy o => o.o_orderpriority | select g => { p: g.key, anyBig: (g.items | any i => i.o_totalprice > 400000), allPos: (g.items | all i => i.o_totalprice > 0), some: (g.items | where i => i.o_orderstatus == "P" | any) }',
        """SELECT o_orderpriority p, coalesce(bool_or(o_totalprice>400000),false) "anyBig", coalesce(bool_and(o_totalprice>0),true) "allPos", coalesce(bool_or(o_orderstatus='P'),false) "some" FROM orders GROUP BY 1""",
    ),
    (
        "group_distinct_count",
        "orders[*] | groupBy o => o.o_custkey | select g => { c: g.key, n: (g.items | select i => i.o_orderstatus | distinct | count) }",
        "SELECT o_custkey c, count(DISTINCT o_orderstatus) n FROM orders GROUP BY 1",
    ),
    (
        "group_first_last",
        "conversations[*] | orderBy c => c.turn | groupBy c => c.conv_id | select g => { id: g.key, opens: (g.items | orderBy i => i.turn | first).role, closes: (g.items | orderBy i => i.turn | last).turn }",
        "SELECT conv_id id, arg_min(role, turn) opens, max(turn) closes FROM conversations GROUP BY 1",
    ),
    (
        "group_take",
        'nation[*] | groupBy n => n.n_regionkey | select g => { r: g.key, firstTwo: (g.items | orderBy i => i.n_name desc | take 2 | select i => i.n_name | concat("+")) }',
        """SELECT r, string_agg(n_name,'+' ORDER BY n_name DESC) "firstTwo" FROM (SELECT n_regionkey r, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) k FROM nation) WHERE k<=2 GROUP BY 1""",
    ),
    (
        "group_order_take",
        "lineitem[*] | groupBy l => l.l_suppkey | select g => { s: g.key, q: (g.items | select i => i.l_quantity | sum) } | orderBy r => r.q desc, r => r.s | take 5",
        "SELECT l_suppkey s, sum(l_quantity) q FROM lineitem GROUP BY 1 ORDER BY q DESC, s LIMIT 5",
    ),
    (
        "correlated_sum",
        "nation[*] | select n => { n: n.n_name, bal: (customer[*] | where c => c.c_nationkey == n.n_nationkey && c.c_acctbal > 0 | select c => c.c_acctbal | sum).round(1) }",
        "SELECT n_name n, round(coalesce((SELECT sum(c_acctbal) FROM customer WHERE c_nationkey=n_nationkey AND c_acctbal>0),0),1) bal FROM nation",
    ),
    (
        "correlated_any",
        'region[*] | select r => { r: r.r_name, has: (nation[*] | any n => n.n_regionkey == r.r_regionkey && n.n_name.startsWith("a")) }',
        "SELECT r_name r, EXISTS (SELECT 1 FROM nation WHERE n_regionkey=r_regionkey AND lower(n_name) LIKE 'a%') has FROM region",
    ),
    (
        "correlated_filter",
        "nation[*] | where n => (customer[*] | where c => c.c_nationkey == n.n_nationkey | count) > 5 | select n => { n: n.n_name }",
        "SELECT n_name n FROM nation WHERE (SELECT count(*) FROM customer WHERE c_nationkey=n_nationkey)>5",
    ),
    (
        "memo_two_args",
        """let f = memo (a, b) => (nation[*] | first n => n.n_nationkey == a && n.n_regionkey == b)
supplier[*] | select s => { s: s.s_suppkey, n: f(s.s_nationkey, 1).n_name }""",
        "SELECT s_suppkey s, n_name n FROM supplier LEFT JOIN nation ON s_nationkey=n_nationkey AND n_regionkey=1",
    ),
    (
        "in_literals",
        'orders[*] | where o => o.o_orderstatus.in(["F", "P"]) && !o.o_orderpriority.in("1-URGENT", "5-LOW") | select o => { k: o.o_orderkey }',
        "SELECT o_orderkey k FROM orders WHERE o_orderstatus IN ('F','P') AND o_orderpriority NOT IN ('1-URGENT','5-LOW')",
    ),
    (
        "in_flag",
        """let big = orders[*] | where o => o.o_totalprice > 300000 | select o => o.o_custkey
customer[*] | select c => { k: c.c_custkey, big: c.c_custkey.in(big) }""",
        "SELECT c_custkey k, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice>300000) big FROM customer",
    ),
    (
        "null_safe",
        'customer[*] | join orders on c => c.c_custkey equals o => o.o_custkey into o left | select r => { c: r.c_custkey, none: r.o == null, same: r.o.o_orderstatus == null, sum: r.o.o_totalprice + 1, t: "x" + r.o.o_orderstatus }',
        """SELECT c_custkey c, o_orderkey IS NULL "none", o_orderstatus IS NULL same, coalesce(o_totalprice,0)+1 "sum", 'x'||coalesce(o_orderstatus,'') t FROM customer LEFT JOIN orders ON c_custkey=o_custkey""",
    ),
    (
        "join_composite",
        'lineitem[*] | join orders on l => { k: l.l_orderkey, s: "F" } equals o => { k: o.o_orderkey, s: o.o_orderstatus } into o | select r => { k: r.l_orderkey, n: r.l_linenumber, p: r.o.o_orderpriority }',
        "SELECT l_orderkey k, l_linenumber n, o_orderpriority p FROM lineitem JOIN orders ON l_orderkey=o_orderkey AND o_orderstatus='F'",
    ),
    (
        "multi_key_sort",
        "supplier[*] | orderBy s => s.s_nationkey desc, s => s.s_name asc | select s => { s: s.s_suppkey, n: s.s_nationkey } | take 7",
        "SELECT s_suppkey s, s_nationkey n FROM supplier ORDER BY s_nationkey DESC, s_name LIMIT 7",
    ),
    (
        "implicit_item",
        "part[*] | where $.p_size > 45 | select { k: $.p_partkey, s: $.p_size }",
        "SELECT p_partkey k, p_size s FROM part WHERE p_size>45",
    ),
    (
        "frame_slice",
        "(customer[*] | orderBy c => c.c_custkey)[3:6] | select c => c.c_custkey",
        "SELECT c_custkey AS value FROM customer ORDER BY 1 LIMIT 3 OFFSET 3",
    ),
    (
        "frame_concat",
        '{ names: (region[*] | orderBy r => r.r_name desc | select r => r.r_name | concat("/")) }',
        """SELECT string_agg(r_name,'/' ORDER BY r_name DESC) AS "names" FROM region""",
    ),
    (
        "frame_reduce",
        "{ total: (lineitem[*] | reduce (acc, l) => acc + l.l_quantity from 0) }",
        "SELECT sum(l_quantity) total FROM lineitem",
    ),
    (
        "frame_reduce_text",
        '{ t: (region[*] | orderBy r => r.r_regionkey | select r => r.r_name | reduce (a, n) => a + ">" + n) }',
        "SELECT string_agg(r_name,'>' ORDER BY r_regionkey) t FROM region",
    ),
    (
        "frame_last",
        "{ k: (customer[*] | orderBy c => c.c_acctbal | last c => c.c_nationkey < 5).c_custkey }",
        "SELECT c_custkey k FROM customer WHERE c_nationkey<5 ORDER BY c_acctbal DESC LIMIT 1",
    ),
    (
        "frame_min_max",
        "{ lo: (part[*] | select p => p.p_retailprice | min), hi: (part[*] | select p => p.p_retailprice | max), n: part[*].count() }",
        "SELECT min(p_retailprice) lo, max(p_retailprice) hi, count(*) n FROM part",
    ),
    (
        "ratio",
        '{ share: (orders[*] | where o => o.o_orderstatus == "F" | count) / (orders[*] | count) }',
        "SELECT count(*) FILTER (o_orderstatus='F') / count(*)::DOUBLE share FROM orders",
    ),
    (
        "distinct_rows",
        "customer[*] | select c => { n: c.c_nationkey, s: c.c_mktsegment } | distinct | count",
        "SELECT count(*) AS value FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)",
    ),
    (
        "select_many_rows",
        "embeddings[*] | select v => { parts: v.embedding } | selectMany r => r.parts | select x => x.round(3)",
        "SELECT round(x::DOUBLE,3)+0.0 AS value FROM (SELECT unnest(embedding) x FROM embeddings)",
    ),
    (
        "array_pipeline",
        "embeddings[*] | select v => { id: v.vec_id, n: (v.embedding | where x => x > 0 | count), first: (v.embedding | first x => x > 0.1), top: (v.embedding | orderBy x => x desc | take 2 | select x => x.round(4)) }",
        'SELECT vec_id id, len(list_filter(embedding, lambda x: x>0)) n, list_filter(embedding, lambda x: x>0.1)[1] "first", list_transform(list_reverse_sort(embedding)[1:2], lambda x: round(x::DOUBLE,4)) top FROM embeddings',
    ),
    (
        "array_slices",
        "embeddings[*] | select v => { id: v.vec_id, a: v.embedding[2:5].count(), b: v.embedding[-3:].count(), c: v.embedding[0] == v.embedding.first(), last: v.embedding.last() }",
        'SELECT vec_id id, len(embedding[3:5]) a, 3::BIGINT b, true c, embedding[-1] "last" FROM embeddings',
    ),
    (
        "array_take_while",
        "embeddings[*] | select v => { id: v.vec_id, n: (v.embedding | index | takeWhile i => i < 4 | count), s: (v.embedding | index | skip 2 | take 3 | sum) }",
        "SELECT vec_id id, 4::BIGINT n, 9::BIGINT s FROM embeddings",
    ),
    (
        "array_batch",
        'documents[*] | select d => { id: d.doc_id, n: (d.text.split(" ") | batch 10 | count) }',
        "SELECT doc_id id, ceil(len(string_split(text,' '))/10.0)::BIGINT n FROM documents",
    ),
    (
        "array_group",
        'documents[*] | select d => { id: d.doc_id, n: (d.lang.toCharArray() | groupBy c => c | count), j: d.lang.toCharArray().concat("-") }',
        "SELECT doc_id id, len(list_distinct(string_split(lang,''))) n, array_to_string(string_split(lang,''),'-') j FROM documents",
    ),
    (
        "array_literal",
        "nation[*] | select n => { k: n.n_nationkey, xs: [n.n_nationkey, ...[n.n_regionkey, 7]], s: ([1, 2, n.n_regionkey] | sum), m: [3, n.n_regionkey, 1].max() }",
        "SELECT n_nationkey k, [n_nationkey::BIGINT, n_regionkey::BIGINT, 7] xs, (3+n_regionkey)::BIGINT s, greatest(3,n_regionkey)::BIGINT m FROM nation",
    ),
    (
        "array_reduce_text",
        'orders[*] | select o => { k: o.o_orderkey, t: (o.o_orderpriority.split("-") | reduce (a, x) => a + "/" + x) }',
        "SELECT o_orderkey k, replace(o_orderpriority,'-','/') t FROM orders",
    ),
    (
        "range_rows",
        "nation[*] | select n => { k: n.n_nationkey, s: (range(1, n.n_regionkey) | sum) }",
        "SELECT n_nationkey k, (n_regionkey*(n_regionkey+1)//2)::BIGINT s FROM nation",
    ),
    (
        "iterate_column",
        "nation[*] | select n => { k: n.n_nationkey, p: (iterate(1, x => x * 2) | take 6 | last) }",
        "SELECT n_nationkey k, 32::BIGINT p FROM nation",
    ),
    (
        "iterate_top",
        "{ fib: (iterate({ a: 0, b: 1 }, s => { a: s.b, b: s.a + s.b }) | take 8 | select s => s.a) }",
        "SELECT [0,1,1,2,3,5,8,13]::BIGINT[] fib",
    ),
    (
        "trim_variants",
        'nation[*] | select n => { k: n.n_nationkey, a: ("  " + n.n_name + "\\t").trim(), b: ("##" + n.n_name).trimStart("#"), c: (n.n_name + "..").trimEnd("."), d: n.n_name.padRight(20, "*") }',
        "SELECT n_nationkey k, n_name a, n_name b, n_name c, rpad(n_name,20,'*') d FROM nation",
    ),
    (
        "url_coding",
        'nation[*] | select n => { k: n.n_nationkey, e: ("a b/" + n.n_name).urlEncode(), d: ("a b/" + n.n_name).urlEncode().urlDecode() }',
        "SELECT n_nationkey k, 'a%20b%2F'||replace(n_name,' ','%20') e, 'a b/'||n_name d FROM nation",
    ),
    (
        "starts_ends",
        'part[*] | select p => { k: p.p_partkey, s: p.p_brand.startsWith("brand#1"), e: p.p_brand.endsWith("3"), n: p.p_brand.length() }',
        "SELECT p_partkey k, lower(p_brand) LIKE 'brand#1%' s, p_brand LIKE '%3' e, length(p_brand) n FROM part",
    ),
    (
        "replace_ci",
        'orders[*] | select o => { k: o.o_orderkey, r: o.o_orderpriority.replace("urgent", "now", true) }',
        "SELECT o_orderkey k, regexp_replace(o_orderpriority,'urgent','now','gi') r FROM orders",
    ),
    (
        "sanitize_text",
        "documents[*] | select d => { id: d.doc_id, s: d.lang.sanitize() }",
        "SELECT doc_id id, lang s FROM documents",
    ),
    (
        "number_modes",
        'lineitem[*] | select l => { k: l.l_orderkey, n: l.l_linenumber, e: l.l_quantity, z: (l.l_extendedprice / 7).round(2, "toZero"), t: (0 - l.l_extendedprice).truncate(), a: (0 - l.l_quantity).abs() }',
        "SELECT l_orderkey k, l_linenumber n, l_quantity e, floor(l_extendedprice/7*100)/100 z, -floor(l_extendedprice) t, l_quantity a FROM lineitem",
    ),
    (
        "number_text",
        'part[*] | select p => { k: p.p_partkey, t: p.p_retailprice.toString("F2"), n: p.p_size.toString("D6"), s: `{p.p_size}` }',
        "SELECT p_partkey k, printf('%.2f', round(p_retailprice,2)) t, lpad(p_size::VARCHAR,6,'0') n, p_size::VARCHAR s FROM part",
    ),
    (
        "convert_kinds",
        'part[*] | select p => { k: p.p_partkey, i: p.p_retailprice.convertTo("Int32"), s: p.p_size.convertTo("String"), b: p.p_name.convertTo("Boolean"), z: p.p_name.toNumber() }',
        "SELECT p_partkey k, trunc(p_retailprice)::BIGINT i, p_size::VARCHAR s, true b, 0.0::DOUBLE z FROM part",
    ),
    (
        "null_checks",
        'customer[*] | join orders on c => c.c_custkey equals o => o.o_custkey into o left | select r => { c: r.c_custkey, a: r.o.o_orderkey.isNull(), b: r.o.o_orderstatus.isEmpty(), d: r.o.o_orderstatus.isNullOrWhiteSpace("-"), e: r.o.o_totalprice.isNull(0) }',
        "SELECT c_custkey c, o_orderkey IS NULL a, o_orderstatus IS NULL b, coalesce(o_orderstatus,'-') d, coalesce(o_totalprice,0) e FROM customer LEFT JOIN orders ON c_custkey=o_custkey",
    ),
    (
        "date_parse",
        'orders[*] | select o => { k: o.o_orderkey, d: o.o_orderdate.dateFormat("yyyy-MM-dd").dateFormat("yyyy-MM-dd", "dd/MM/yyyy"), bad: o.o_orderstatus.tryDateFormat("yyyy") }',
        "SELECT o_orderkey k, strftime(o_orderdate,'%d/%m/%Y') d, o_orderstatus bad FROM orders",
    ),
    (
        "text_lines",
        'documents[*] | select d => { id: d.doc_id, n: (d.text.fromText() | count), e: (d.text.fromText() | where l => l.contains("THE") | count), t: d.text.fromText().toText({ delimiter: "|" }).length() }',
        "SELECT doc_id id, len(string_split(text,chr(10))) n, len(list_filter(string_split(text,chr(10)), lambda l: contains(lower(l),'the'))) e, length(replace(text,chr(10),'|')) t FROM documents",
    ),
    (
        "descend",
        "nation[*] | select n => { k: n.n_nationkey, all: ({ v: n.n_regionkey, w: { v: n.n_nationkey } }..v | sum) }",
        'SELECT n_nationkey k, CAST(n_regionkey + n_nationkey AS BIGINT) "all" FROM nation',
    ),
    (
        "omit_nulls",
        "orders[*] | select o => { k: o.o_orderkey, kept: `{{ a: if o.o_totalprice > 100000 then o.o_orderstatus else null, b: o.o_orderkey }.omitNulls()}` }",
        """SELECT o_orderkey k, CASE WHEN o_totalprice > 100000 THEN '{"a":"' || o_orderstatus || '","b":' || o_orderkey || '}' ELSE '{"b":' || o_orderkey || '}' END kept FROM orders""",
    ),
    (
        "csv_no_headers",
        'nation[*] | select n => { k: n.n_nationkey, b: (n.n_name.concat(",", n.n_regionkey.toString()).fromCsv({ headers: false }) | first).B }',
        "SELECT n_nationkey k, CAST(n_regionkey AS VARCHAR) b FROM nation",
    ),
    (
        "parquet_round_trip",
        'nation[*] | select n => { k: n.n_nationkey, back: [{ a: n.n_name, b: n.n_regionkey }].toParquet({ schema: [{ name: "a", type: "string" }, { name: "b", type: "int64" }] }).fromParquet().first().a }',
        "SELECT n_nationkey k, n_name back FROM nation",
    ),
    (
        "xlsx_round_trip",
        "nation[*] | select n => { k: n.n_nationkey, back: [{ a: n.n_name, b: n.n_regionkey }].toXlsx().fromXlsx().first().b }",
        "SELECT n_nationkey k, CAST(n_regionkey AS VARCHAR) back FROM nation",
    ),
    (
        "iterate_while",
        "nation[*] | select n => { k: n.n_nationkey, p: (iterate(n.n_nationkey + 1, x => x * 2) | takeWhile x => x < 50 | sum) }",
        "WITH RECURSIVE r AS (SELECT n_nationkey k, n_nationkey + 1 x FROM nation UNION ALL SELECT k, x * 2 FROM r WHERE x * 2 < 50) SELECT k, CAST(sum(x) AS BIGINT) p FROM r GROUP BY 1",
    ),
    (
        "iterate_first",
        "nation[*] | select n => { k: n.n_nationkey, p: (iterate(n.n_nationkey + 1, x => x * 2) | first x => x > 100) }",
        "WITH RECURSIVE r AS (SELECT n_nationkey k, n_nationkey + 1 x FROM nation UNION ALL SELECT k, x * 2 FROM r WHERE x <= 100) SELECT k, CAST(max(x) AS BIGINT) p FROM r GROUP BY 1",
    ),
    (
        "clock_and_guid",
        'nation[*] | select n => { k: n.n_nationkey, y: now("yyyy").length(), d: utcNow("yyyy-MM-dd").length(), g: newGuid().length() }',
        "SELECT n_nationkey k, 4::BIGINT y, 10::BIGINT d, 36::BIGINT g FROM nation",
    ),
    (
        "batch_texts",
        "customer[*] | orderBy c => c.c_name desc | batch 100 | select b => { first: (b | first).c_name, n: (b | count) }",
        'SELECT max(c_name) "first", count(*) n FROM (SELECT c_name, (row_number() OVER (ORDER BY c_name DESC)-1)//100 g FROM customer) GROUP BY g',
    ),
    (
        "index_sorted",
        "lineitem[*] | orderBy l => l.l_extendedprice desc | index | sum",
        "SELECT CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS value FROM lineitem",
    ),
    (
        "csv_round_trip",
        "nation[*] | select n => { k: n.n_nationkey, c: [{ a: n.n_name, b: n.n_regionkey }].toCsv(), back: [{ a: n.n_name, b: n.n_regionkey }].toCsv().fromCsv().first().a }",
        "SELECT n_nationkey k, 'a,b'||chr(10)||n_name||','||n_regionkey c, n_name back FROM nation",
    ),
    (
        "xml_round_trip",
        "nation[*] | select n => { k: n.n_nationkey, x: { n: { name: n.n_name, r: n.n_regionkey } }.toXml({ declaration: false }), back: { n: { name: n.n_name } }.toXml().fromXml().n.name.toString() }",
        "SELECT n_nationkey k, '<n>'||chr(10)||'  <name>'||n_name||'</name>'||chr(10)||'  <r>'||n_regionkey||'</r>'||chr(10)||'</n>' x, n_name back FROM nation",
    ),
    (
        "remove_fields",
        'region[*] | select r => r.remove("r_comment")',
        "SELECT r_regionkey, r_name FROM region",
    ),
    (
        "keep_list",
        'nation[*] | select n => { k: n.n_nationkey, o: [n.keep("n_name", "n_regionkey")].count(), c: n.clone().n_name }',
        "SELECT n_nationkey k, 1::BIGINT o, n_name c FROM nation",
    ),
    (
        "computed_key",
        "nation[*] | select n => { [`id_{1 + 1}`]: n.n_nationkey, up: if n.n_regionkey == 1 then n.n_name }",
        "SELECT n_nationkey id_2, CASE WHEN n_regionkey=1 THEN n_name END up FROM nation",
    ),
    (
        "match_number",
        'part[*] | select p => { k: p.p_partkey, s: (p.p_size | match 1 => "one", 2 => "two") }',
        "SELECT p_partkey k, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END s FROM part",
    ),
    (
        "truthiness",
        'part[*] | select p => { k: p.p_partkey, a: !p.p_size, b: boolean(p.p_name), c: not(p.p_size - p.p_size), d: p.p_size && "" }',
        "SELECT p_partkey k, p_size=0 a, true b, true c, false d FROM part",
    ),
    (
        "optional_names",
        "nation[*] | select n => { k: n.n_nationkey, a: n.nothing?, b: n?.n_name.length() }",
        "SELECT n_nationkey k, CAST(NULL AS INTEGER) a, length(n_name) b FROM nation",
    ),
    (
        "take_natural",
        "nation[*] | take 4 | select n => n.n_nationkey",
        "SELECT n_nationkey AS value FROM nation LIMIT 4",
    ),
    (
        "batch_natural",
        "nation[*] | batch 7 | select b => b.count()",
        "SELECT count(*) AS value FROM (SELECT (row_number() OVER ()-1)//7 g FROM nation) GROUP BY g",
    ),
    (
        "event_types",
        "events[*] | groupBy e => e.event_type | select g => { t: g.key, n: (g.items | count), users: (g.items | select e => e.user_id | distinct | count) } | orderBy r => r.t",
        "SELECT event_type t, count(*) n, count(DISTINCT user_id) users FROM events GROUP BY 1 ORDER BY 1",
    ),
    (
        "page_titles",
        'pages[*] | select p => { id: p.page_id, h1: p.html.regex("<h1>[^<]*</h1>").first().replace("<h1>", "").replace("</h1>", "") }',
        "SELECT page_id id, replace(replace(regexp_extract_all(html,'<h1>[^<]*</h1>')[1],'<h1>',''),'</h1>','') h1 FROM pages",
    ),
    (
        "let_frames",
        """let open = orders[*] | where o => o.o_orderstatus == "O"
let big = open | where o => o.o_totalprice > 100000
return { open: (open | count), big: (big | count), share: ((big | count) / (open | count)).round(6) }""",
        "SELECT count(*) open, count(*) FILTER (o_totalprice>100000) big, round(count(*) FILTER (o_totalprice>100000)/count(*)::DOUBLE,6) share FROM orders WHERE o_orderstatus='O'",
    ),
]


def _query(script: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).bind_folder(sf_dir, *(t for t in TABLES if t in script)).query(script)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(script) for name, script, _ in CATALOGUE}
ORACLES: dict[str, str] = {name: sql for name, _, sql in CATALOGUE}
