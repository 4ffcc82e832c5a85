"""SPARQL queries over the test tables, each with an SQL twin."""

from __future__ import annotations

from .engine import Engine
from .sources import tables

FLAGSHIP = """SELECT ?name (COUNT(*) AS ?cnt) (SUM(?price) AS ?sum) WHERE {
  ?o t:o_custkey ?c ; t:o_totalprice ?price . ?c t:c_nationkey ?n . ?n t:n_name ?name } GROUP BY ?name"""

#: Name: SPARQL, SQL. IRIs come out as strings.
PAIRS: dict[str, tuple[str, str]] = {
    # joins of patterns
    "bgp_star": ("SELECT ?o ?p ?s WHERE { ?o t:o_totalprice ?p ; t:o_orderstatus ?s ; t:o_orderpriority '1-URGENT' }", "SELECT 'urn:t:orders/' || o_orderkey AS o, o_totalprice AS p, o_orderstatus AS s FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "bgp_chain": (
        "SELECT ?r (COUNT(*) AS ?n) WHERE { ?o t:o_custkey ?c . ?c t:c_nationkey ?x . ?x t:n_regionkey ?y . ?y t:r_name ?r } GROUP BY ?r",
        "SELECT r_name AS r, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "bgp_snowflake": (
        "SELECT ?n ?b (COUNT(*) AS ?k) (SUM(?q) AS ?sq) WHERE { ?l t:l_orderkey ?o ; t:l_partkey ?p ; t:l_quantity ?q . ?o t:o_custkey ?c . ?c t:c_nationkey ?x . ?x t:n_name ?n . ?p t:p_brand ?b } GROUP BY ?n ?b",
        "SELECT n_name AS n, p_brand AS b, count(*) AS k, sum(l_quantity) AS sq FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    ),
    "bgp_cycle": (
        "SELECT ?c ?s WHERE { ?l t:l_orderkey ?o ; t:l_suppkey ?s . ?o t:o_custkey ?c . ?c t:c_nationkey ?n . ?s t:s_nationkey ?n . ?c t:c_mktsegment 'BUILDING' }",
        "SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:supplier/' || s_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "bgp_constant_subject": ("SELECT ?n ?r WHERE { <urn:t:nation/7> t:n_name ?n ; t:n_regionkey ?r }", "SELECT n_name AS n, 'urn:t:region/' || n_regionkey AS r FROM nation WHERE n_nationkey = 7"),
    "bgp_constant_object": ("SELECT ?c ?a WHERE { ?c t:c_nationkey <urn:t:nation/7> ; t:c_acctbal ?a }", "SELECT 'urn:t:customer/' || c_custkey AS c, c_acctbal AS a FROM customer WHERE c_nationkey = 7"),
    "bgp_repeated_variable": ("SELECT ?c WHERE { ?c t:c_nationkey ?n . ?n t:n_nationkey ?k . ?n t:n_regionkey ?r . ?r t:r_regionkey ?k }", "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = n_nationkey"),
    "bgp_class": ("SELECT ?k (COUNT(*) AS ?n) WHERE { ?x a ?k } GROUP BY ?k HAVING (COUNT(*) < 200)", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'urn:t:class:{t}' AS k, count(*) AS n FROM {t}" for t in tables.TABLES) + ") WHERE n > 0 AND n < 200"),
    "bgp_variable_predicate": (
        "SELECT ?p (COUNT(?o) AS ?n) (COUNT(DISTINCT ?o) AS ?d) WHERE { ?s ?p ?o . ?s t:n_name ?x } GROUP BY ?p",
        "SELECT p, count(*) AS n, count(DISTINCT o) AS d FROM (SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'urn:t:class:nation' AS o FROM nation UNION ALL SELECT 'urn:t:n_nationkey', n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'urn:t:n_name', n_name FROM nation UNION ALL SELECT 'urn:t:n_regionkey', 'urn:t:region/' || n_regionkey FROM nation) GROUP BY 1",
    ),
    "cross_product": ("SELECT ?r ?s WHERE { ?x t:r_name ?r . { SELECT DISTINCT ?s { ?c t:c_mktsegment ?s } } }", "SELECT r_name AS r, s FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer)"),
    # filters
    "filter_cmp": ("SELECT ?e ?v WHERE { ?e t:value ?v FILTER(?v > 90 && ?v <= 95.5) }", "SELECT 'urn:t:events/' || event_id AS e, value AS v FROM events WHERE value > 90 AND value <= 95.5"),
    "filter_logic": ("SELECT ?p WHERE { ?p t:p_size ?s ; t:p_brand ?b FILTER((?s < 5 || ?s >= 45) && !(?b = 'Brand#11')) }", "SELECT 'urn:t:part/' || p_partkey AS p FROM part WHERE (p_size < 5 OR p_size >= 45) AND p_brand <> 'Brand#11'"),
    "filter_in": ("SELECT ?c WHERE { ?c t:c_mktsegment ?s ; t:c_nationkey ?n FILTER(?s IN ('BUILDING', 'MACHINERY') && ?n NOT IN (<urn:t:nation/1>, <urn:t:nation/2>)) }", "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2)"),
    "filter_regex": ("SELECT ?n WHERE { ?x t:p_name ?n FILTER REGEX(?n, '^(RED|blue).*t$', 'i') }", "SELECT p_name AS n FROM part WHERE regexp_matches(p_name, '^(RED|blue).*t$', 'i')"),
    "filter_str": ("SELECT ?n WHERE { ?x t:n_name ?n FILTER(STRSTARTS(?n, 'NATION_1') && CONTAINS(STR(?x), 'nation/1') && STRLEN(?n) = 9) }", "SELECT n_name AS n FROM nation WHERE n_name LIKE 'NATION\\_1%' ESCAPE '\\' AND 'urn:t:nation/' || n_nationkey LIKE '%nation/1%' AND length(n_name) = 9"),
    "filter_bound": ("SELECT ?d WHERE { ?d t:lang ?l OPTIONAL { ?d t:quality ?q } FILTER(!BOUND(?q) && ?l != 'en') }", "SELECT 'urn:t:documents/' || d.doc_id AS d FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL AND lang <> 'en'"),
    "filter_numeric_cast": ("SELECT ?n WHERE { ?x t:n_name ?n FILTER(xsd:integer(STRAFTER(?n, '_')) > 20) }", "SELECT n_name AS n FROM nation WHERE CAST(substr(n_name, 8) AS INTEGER) > 20"),
    "filter_error_drops_row": ("SELECT ?n WHERE { ?x t:r_name ?n FILTER(xsd:integer(?n) > 0 || ?n = 'ASIA') }", "SELECT r_name AS n FROM region WHERE r_name = 'ASIA'"),
    "filter_iri": ("SELECT ?o WHERE { ?o t:o_custkey ?c FILTER(?c = <urn:t:customer/7> || ?c = <urn:t:supplier/8>) }", "SELECT 'urn:t:orders/' || o_orderkey AS o FROM orders WHERE o_custkey = 7"),
    # optional, minus, exists
    "optional_left": ("SELECT ?d ?q WHERE { ?d t:source ?s OPTIONAL { ?d t:quality ?q } }", "SELECT 'urn:t:documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "optional_filter_inside": ("SELECT ?d ?q WHERE { ?d t:n_chars ?n OPTIONAL { ?d t:quality ?q FILTER(?n > 2000 && ?q = 1) } }", "SELECT 'urn:t:documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND n_chars > 2000 AND quality = 1"),
    "optional_nested": (
        "SELECT ?n ?s ?b WHERE { ?x t:n_name ?n OPTIONAL { ?y t:s_nationkey ?x ; t:s_name ?s OPTIONAL { ?y t:s_acctbal ?b FILTER(?b > 0) } } }",
        "SELECT n_name AS n, s_name AS s, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS b FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey",
    ),
    "null_compatible_join": (
        "SELECT ?d ?q ?k WHERE { ?d t:lang 'fr' OPTIONAL { ?d t:quality ?q } { SELECT ?q (COUNT(*) AS ?k) { ?e t:quality ?q } GROUP BY ?q } }",
        "WITH k AS (SELECT quality AS q, count(*) AS k FROM labels GROUP BY 1), d AS (SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'fr') SELECT 'urn:t:documents/' || doc_id AS d, k.q AS q, k FROM d JOIN k ON d.quality = k.q OR d.quality IS NULL",
    ),
    "minus": ("SELECT ?d WHERE { ?d t:lang 'de' MINUS { ?d t:quality ?q } }", "SELECT 'urn:t:documents/' || doc_id AS d FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM labels)"),
    "minus_no_shared": ("SELECT ?r WHERE { ?x t:r_name ?r MINUS { ?y t:n_name ?n } }", "SELECT r_name AS r FROM region"),
    "not_exists": ("SELECT ?n WHERE { ?x t:n_name ?n FILTER NOT EXISTS { ?s t:s_nationkey ?x ; t:s_acctbal ?b FILTER(?b > 9000) } }", "SELECT n_name AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)"),
    "exists": ("SELECT ?c WHERE { ?c t:c_mktsegment 'AUTOMOBILE' FILTER EXISTS { ?o t:o_custkey ?c ; t:o_orderstatus 'F' } }", "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "exists_correlated": ("SELECT ?c WHERE { ?c t:c_acctbal ?a FILTER EXISTS { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > ?a * 50) } }", "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)"),
    "exists_in_expression": ("SELECT ?n WHERE { ?x t:n_name ?n FILTER(?n = 'NATION_3' || EXISTS { ?s t:s_nationkey ?x ; t:s_acctbal ?b FILTER(?b > 9000) }) }", "SELECT n_name AS n FROM nation WHERE n_name = 'NATION_3' OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)"),
    # rows without a key, known by their place in the file
    "keyless_optional": ("SELECT ?f (COUNT(*) AS ?n) (SUM(?q) AS ?s) WHERE { ?l t:l_returnflag ?f ; t:l_linenumber ?k OPTIONAL { ?l t:l_quantity ?q FILTER(?q < 25) } FILTER(?k > 2) } GROUP BY ?f", "SELECT l_returnflag AS f, count(*) AS n, coalesce(sum(CASE WHEN l_quantity < 25 THEN l_quantity END), 0) AS s FROM lineitem WHERE l_linenumber > 2 GROUP BY 1"),
    "keyless_exists": ("SELECT ?f (COUNT(*) AS ?n) WHERE { ?l t:l_returnflag ?f FILTER EXISTS { ?l t:l_returnflag 'R' } } GROUP BY ?f", "SELECT l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"),
    "keyless_minus": ("SELECT ?f (COUNT(*) AS ?n) WHERE { ?l t:l_returnflag ?f MINUS { ?l t:l_quantity ?q FILTER(?q > 10) } } GROUP BY ?f", "SELECT l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_quantity <= 10 GROUP BY 1"),
    "keyless_group": ("SELECT ?n (COUNT(*) AS ?k) WHERE { { SELECT ?l (COUNT(*) AS ?n) { { ?l t:l_returnflag 'R' } UNION { ?l t:l_linestatus 'F' } } GROUP BY ?l } ?l t:l_discount ?d FILTER(?d < 0.05) } GROUP BY ?n", "SELECT n, count(*) AS k FROM (SELECT (l_returnflag = 'R')::BIGINT + (l_linestatus = 'F')::BIGINT AS n FROM lineitem WHERE l_discount < 0.05) WHERE n > 0 GROUP BY 1"),
    "keyless_union": ("SELECT (COUNT(DISTINCT ?l) AS ?n) WHERE { { ?l t:l_returnflag 'R' } UNION { ?l t:l_linenumber 1 } }", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' OR l_linenumber = 1"),
    # variables that may be unbound on either side
    "optional_twice": (
        "SELECT ?d ?q ?n WHERE { ?d t:lang 'de' OPTIONAL { ?d t:quality ?q } OPTIONAL { ?x t:r_regionkey ?q ; t:r_name ?n } }",
        "SELECT 'urn:t:documents/' || d.doc_id AS d, CASE WHEN quality IS NULL THEN r_regionkey ELSE quality END AS q, r_name AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN region ON r_regionkey = quality OR quality IS NULL WHERE lang = 'de'",
    ),
    "optional_of_optional": (
        "SELECT ?n ?k ?q WHERE { VALUES (?n ?q) { (1 0) (2 UNDEF) (3 7) } OPTIONAL { { SELECT ?q (COUNT(*) AS ?k) { ?d t:lang 'fr' OPTIONAL { ?d t:quality ?q } } GROUP BY ?q } FILTER(?k > ?n) } }",
        "WITH k AS (SELECT quality AS q, count(*) AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'fr' GROUP BY 1), v(n, q) AS (VALUES (1::BIGINT, 0::BIGINT), (2, NULL), (3, 7)) SELECT n, k, coalesce(v.q, k.q) AS q FROM v LEFT JOIN k ON (v.q = k.q OR v.q IS NULL OR k.q IS NULL) AND k > n",
    ),
    "minus_unbound": (
        "SELECT ?d ?q WHERE { ?d t:lang 'es' OPTIONAL { ?d t:quality ?q } MINUS { ?d t:source ?s OPTIONAL { ?e t:toxic ?q FILTER(?e = ?d) } FILTER(?s = 'src3') } }",
        "SELECT 'urn:t:documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'es' AND (source <> 'src3' OR quality IS DISTINCT FROM toxic)",
    ),
    "exists_unbound": (
        "SELECT ?d WHERE { ?d t:lang 'fr' OPTIONAL { ?d t:quality ?q } FILTER EXISTS { ?x t:r_regionkey ?q ; t:r_name 'AFRICA' } }",
        "SELECT 'urn:t:documents/' || d.doc_id AS d FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'fr' AND EXISTS (SELECT 1 FROM region WHERE r_name = 'AFRICA' AND (quality IS NULL OR quality = r_regionkey))",
    ),
    "exists_bind": (
        "SELECT ?s (COUNT(*) AS ?n) WHERE { ?o t:o_custkey ?c ; t:o_totalprice ?p BIND(IF(EXISTS { ?c t:c_acctbal ?b FILTER(?b * 20 > ?p) }, 'rich', 'poor') AS ?s) } GROUP BY ?s",
        "SELECT CASE WHEN c_acctbal * 20 > o_totalprice THEN 'rich' ELSE 'poor' END AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    ),
    # EXISTS whose nested parts use variables of the row outside
    "exists_in_exists": (
        "SELECT ?c WHERE { ?c t:c_acctbal ?a FILTER EXISTS { ?o t:o_custkey ?c ; t:o_orderstatus 'F' FILTER EXISTS { ?l t:l_orderkey ?o ; t:l_extendedprice ?p FILTER(?p > ?a * 15) } } }",
        "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > c_acctbal * 15))",
    ),
    "not_exists_nested_group": (
        "SELECT ?c WHERE { ?c t:c_acctbal ?a FILTER NOT EXISTS { { ?o t:o_totalprice ?p FILTER(?p > ?a * 50) } ?o t:o_custkey ?c } }",
        "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)",
    ),
    "exists_union_correlated": (
        "SELECT ?n WHERE { ?n t:n_nationkey ?k FILTER EXISTS { { ?c t:c_nationkey ?n ; t:c_acctbal ?b FILTER(?b > 9990 - ?k) } UNION { ?s t:s_nationkey ?n ; t:s_acctbal ?b FILTER(?b < ?k * -20) } } }",
        "SELECT 'urn:t:nation/' || n_nationkey AS n FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9990 - n_nationkey) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < n_nationkey * -20)",
    ),
    "exists_optional_filter": (
        "SELECT ?c WHERE { ?c t:c_acctbal ?b FILTER NOT EXISTS { ?o t:o_custkey ?c OPTIONAL { ?o t:o_totalprice ?p FILTER(?p > ?b * 50) } FILTER(BOUND(?p)) } }",
        "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)",
    ),
    "exists_minus_correlated": (
        "SELECT ?c WHERE { ?c t:c_acctbal ?a FILTER EXISTS { ?o t:o_custkey ?c MINUS { ?o t:o_totalprice ?p FILTER(?p > ?a * 30) } } }",
        "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > c_acctbal * 30)",
    ),
    "exists_nested_unbound": (
        "SELECT ?d ?q WHERE { ?d t:lang 'fr' OPTIONAL { ?d t:quality ?q } FILTER EXISTS { ?x t:r_name ?n FILTER NOT EXISTS { ?x t:r_regionkey ?q FILTER(?n != 'AFRICA') } FILTER(?n < 'B') } }",
        "SELECT 'urn:t:documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'fr' AND EXISTS (SELECT 1 FROM region r WHERE r_name < 'B' AND NOT EXISTS (SELECT 1 FROM region x WHERE x.r_regionkey = r.r_regionkey AND (quality IS NULL OR quality = x.r_regionkey) AND r.r_name <> 'AFRICA'))",
    ),
    "optional_exists": (
        "SELECT ?n ?s WHERE { ?x t:n_name ?n ; t:n_nationkey ?k OPTIONAL { ?y t:s_nationkey ?x ; t:s_name ?s FILTER EXISTS { ?c t:c_nationkey ?x ; t:c_acctbal ?a FILTER(?a > 9990 - ?k) } } }",
        "SELECT n_name AS n, s_name AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9990 - n_nationkey)",
    ),
    "exists_in_having": (
        "SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c t:c_nationkey ?n } GROUP BY ?n HAVING (COUNT(?c) > 60 || EXISTS { ?s t:s_nationkey ?n ; t:s_acctbal ?b FILTER(?b > 9000) })",
        "SELECT 'urn:t:nation/' || c_nationkey AS n, count(*) AS k FROM customer GROUP BY c_nationkey HAVING count(*) > 60 OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 9000)",
    ),
    "exists_in_aggregate": (
        "SELECT ?m (SUM(IF(EXISTS { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > ?a * 50) }, 1, 0)) AS ?k) WHERE { ?c t:c_mktsegment ?m ; t:c_acctbal ?a } GROUP BY ?m",
        "SELECT c_mktsegment AS m, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)) AS k FROM customer GROUP BY 1",
    ),
    "exists_in_order": (
        "SELECT ?n WHERE { ?x t:n_name ?n } ORDER BY DESC(EXISTS { ?s t:s_nationkey ?x ; t:s_acctbal ?b FILTER(?b > 9000) }) ?n LIMIT 7",
        "SELECT n_name AS n FROM nation ORDER BY EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) DESC, n_name LIMIT 7",
    ),
    # variable predicates of constants and of joined subjects
    "bgp_predicates_of_constant": (
        "SELECT ?p ?o WHERE { <urn:t:orders/5> ?p ?o FILTER(?p != t:o_orderdate && ?p != t:o_totalprice) }",
        "SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:t:o_orderkey', 'urn:t:o_custkey', 'urn:t:o_orderstatus', 'urn:t:o_orderpriority']) AS p, unnest(['urn:t:class:orders', o_orderkey::VARCHAR, 'urn:t:customer/' || o_custkey, o_orderstatus, o_orderpriority]) AS o FROM orders WHERE o_orderkey = 5",
    ),
    "bgp_predicates_to_constant": ("SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p <urn:t:nation/3> } GROUP BY ?p", "SELECT 'urn:t:c_nationkey' AS p, count(*) AS n FROM customer WHERE c_nationkey = 3 HAVING n > 0 UNION ALL SELECT 'urn:t:s_nationkey', count(*) AS n FROM supplier WHERE s_nationkey = 3 HAVING n > 0"),
    "path_plus_backward": ("SELECT ?x WHERE { ?x (t:s_nationkey|t:n_regionkey)+ <urn:t:region/2> }", "SELECT 'urn:t:nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'urn:t:supplier/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2"),
    "path_star_ends": ("SELECT (COUNT(*) AS ?n) WHERE { <urn:t:supplier/3> (t:s_nationkey|t:n_regionkey)* ?y . ?y t:r_name|t:n_name|t:s_name ?z }", "SELECT count(*) * 3 AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 3"),
    # union, values, sub-select
    "union_bag": ("SELECT ?n WHERE { { ?x t:c_nationkey ?n } UNION { ?x t:s_nationkey ?n } }", "SELECT 'urn:t:nation/' || c_nationkey AS n FROM customer UNION ALL SELECT 'urn:t:nation/' || s_nationkey FROM supplier"),
    "union_missing_vars": ("SELECT ?a ?b WHERE { { ?x t:c_acctbal ?a } UNION { ?x t:s_acctbal ?b } }", "SELECT c_acctbal AS a, CAST(NULL AS DOUBLE) AS b FROM customer UNION ALL SELECT NULL, s_acctbal FROM supplier"),
    "union_of_prefixes": ("SELECT ?x ?k WHERE { { ?x t:n_regionkey ?k } UNION { ?x t:c_nationkey ?k FILTER(?x = <urn:t:customer/5>) } }", "SELECT 'urn:t:nation/' || n_nationkey AS x, 'urn:t:region/' || n_regionkey AS k FROM nation UNION ALL SELECT 'urn:t:customer/5', 'urn:t:nation/' || c_nationkey FROM customer WHERE c_custkey = 5"),
    "values_join": ("SELECT ?n ?w WHERE { VALUES (?n ?w) { ('NATION_1' 10) ('NATION_2' 20) ('nowhere' 30) } ?x t:n_name ?n }", "SELECT n_name AS n, CASE n_name WHEN 'NATION_1' THEN 10 ELSE 20 END::BIGINT AS w FROM nation WHERE n_name IN ('NATION_1', 'NATION_2')"),
    "values_undef": ("SELECT ?x ?n ?w WHERE { VALUES (?x ?w) { (<urn:t:region/1> 1) (UNDEF 2) } ?x t:r_name ?n }", "SELECT 'urn:t:region/' || r_regionkey AS x, r_name AS n, 2::BIGINT AS w FROM region UNION ALL SELECT 'urn:t:region/1', r_name, 1 FROM region WHERE r_regionkey = 1"),
    "subselect_topk": ("SELECT ?n ?p WHERE { { SELECT ?o ?p WHERE { ?o t:o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 10 } ?o t:o_custkey ?c . ?c t:c_name ?n }", "SELECT c_name AS n, o_totalprice AS p FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, 'urn:t:orders/' || o_orderkey LIMIT 10) JOIN customer ON o_custkey = c_custkey"),
    # aggregation
    "agg_count_star": ("SELECT ?s (COUNT(*) AS ?n) WHERE { ?o t:o_orderstatus ?s } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1"),
    "agg_count_distinct": ("SELECT ?t (COUNT(DISTINCT ?u) AS ?n) WHERE { ?e t:event_type ?t ; t:user_id ?u } GROUP BY ?t", "SELECT event_type AS t, count(DISTINCT user_id) AS n FROM events GROUP BY 1"),
    "agg_sum_avg_empty": ("SELECT (SUM(?v) AS ?s) (AVG(?v) AS ?a) (COUNT(?v) AS ?n) WHERE { ?e t:value ?v FILTER(?v < -1000000) }", "SELECT 0.0::DOUBLE AS s, 0.0::DOUBLE AS a, 0::BIGINT AS n"),
    "agg_min_max": ("SELECT ?s (MIN(?p) AS ?lo) (MAX(?p) AS ?hi) (MIN(?d) AS ?first) WHERE { ?o t:o_orderstatus ?s ; t:o_totalprice ?p ; t:o_orderdate ?d } GROUP BY ?s", "SELECT o_orderstatus AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first FROM orders GROUP BY 1"),
    "agg_sample": ("SELECT ?n (SAMPLE(?r) AS ?any) WHERE { ?x t:n_name ?n ; t:n_regionkey ?r } GROUP BY ?n", "SELECT n_name AS n, 'urn:t:region/' || n_regionkey AS any FROM nation"),
    "agg_group_concat": ("SELECT ?r (GROUP_CONCAT(?n; SEPARATOR=', ') AS ?ns) WHERE { ?x t:n_regionkey ?y ; t:n_name ?n . ?y t:r_name ?r } GROUP BY ?r", "SELECT r_name AS r, string_agg(n_name, ', ' ORDER BY n_name) AS ns FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "agg_having": ("SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o t:o_custkey ?c } GROUP BY ?c HAVING (COUNT(?o) > 14)", "SELECT 'urn:t:customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 14"),
    "agg_implicit_group": ("SELECT (COUNT(*) AS ?n) WHERE { ?x t:n_name 'nowhere' }", "SELECT 0::BIGINT AS n"),
    "agg_group_by_expression": ("SELECT ?y (COUNT(*) AS ?n) WHERE { ?o t:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "agg_unbound_group": ("SELECT ?q (COUNT(*) AS ?n) (COUNT(?q) AS ?b) WHERE { ?d t:lang ?l OPTIONAL { ?d t:quality ?q } } GROUP BY ?q", "SELECT quality AS q, count(*) AS n, count(quality) AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"),
    "agg_expression": ("SELECT ?f (SUM(?p * (1 - ?d)) / COUNT(*) AS ?mean) WHERE { ?l t:l_returnflag ?f ; t:l_extendedprice ?p ; t:l_discount ?d } GROUP BY ?f", "SELECT l_returnflag AS f, sum(l_extendedprice * (1 - l_discount)) / count(*) AS mean FROM lineitem GROUP BY 1"),
    "agg_sum_distinct": ("SELECT (SUM(DISTINCT ?s) AS ?t) (AVG(DISTINCT ?s) AS ?a) WHERE { ?p t:p_size ?s }", "SELECT sum(DISTINCT p_size)::BIGINT AS t, avg(DISTINCT p_size) AS a FROM part"),
    "agg_non_numeric_is_unbound": ("SELECT (SUM(?n) AS ?s) (COUNT(?n) AS ?k) WHERE { ?x t:n_name ?n }", "SELECT CAST(NULL AS DOUBLE) AS s, count(*) AS k FROM nation"),
    # order, limit, distinct
    "order_limit_offset": ("SELECT ?c ?a WHERE { ?c t:c_acctbal ?a } ORDER BY DESC(?a) ?c LIMIT 10 OFFSET 5", "SELECT 'urn:t:customer/' || c_custkey AS c, c_acctbal AS a FROM customer ORDER BY a DESC, c LIMIT 10 OFFSET 5"),
    "order_unbound_first": ("SELECT ?d ?q WHERE { ?d t:lang 'es' OPTIONAL { ?d t:quality ?q } } ORDER BY ?q ?d LIMIT 15", "SELECT 'urn:t:documents/' || d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'es' ORDER BY q NULLS FIRST, d LIMIT 15"),
    "distinct_project": ("SELECT DISTINCT ?n WHERE { ?o t:o_custkey ?c . ?c t:c_nationkey ?n }", "SELECT DISTINCT 'urn:t:nation/' || c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey"),
    "reduced_project": ("SELECT REDUCED ?s WHERE { ?c t:c_mktsegment ?s }", "SELECT DISTINCT c_mktsegment AS s FROM customer"),
    "select_star": ("SELECT * WHERE { ?x t:r_name ?name }", "SELECT 'urn:t:region/' || r_regionkey AS x, r_name AS name FROM region"),
    # expressions
    "bind_expr": ("SELECT ?p ?tax WHERE { ?x t:p_retailprice ?p ; t:p_size ?s BIND(?p * 0.5 + ?s AS ?tax) FILTER(?tax > 470) }", "SELECT p_retailprice AS p, p_retailprice * 0.5 + p_size AS tax FROM part WHERE p_retailprice * 0.5 + p_size > 470"),
    "fn_string": (
        "SELECT (UCASE(?n) AS ?u) (LCASE(?n) AS ?l) (SUBSTR(?n, 2, 3) AS ?s) (STRBEFORE(?n, '_') AS ?b) (STRAFTER(?n, '#') AS ?a) (CONCAT(?n, '-', STR(?k)) AS ?c) (STRLEN(?n) AS ?len) (REPLACE(?n, '[0-9]+', 'x') AS ?r) (STRENDS(?n, '1') AS ?e) WHERE { ?x t:n_name ?n ; t:n_nationkey ?k }",
        "SELECT upper(n_name) AS u, lower(n_name) AS l, substr(n_name, 2, 3) AS s, 'NATION' AS b, '' AS a, n_name || '-' || n_nationkey AS c, length(n_name)::INTEGER AS len, regexp_replace(n_name, '[0-9]+', 'x', 'g') AS r, n_name LIKE '%1' AS e FROM nation",
    ),
    "fn_numeric_round_half_up": (
        "SELECT ?k (ROUND(?k - 2.5) AS ?r) (CEIL(?k / 2) AS ?c) (FLOOR(?k / 2) AS ?f) (ABS(?k - 10) AS ?a) (-?k AS ?m) (?k / 0 AS ?e) WHERE { ?x t:r_regionkey ?k }",
        "SELECT r_regionkey AS k, floor(r_regionkey - 2.0)::DOUBLE AS r, ceil(r_regionkey / 2)::DOUBLE AS c, floor(r_regionkey / 2)::DOUBLE AS f, abs(r_regionkey - 10)::BIGINT AS a, (-r_regionkey)::INTEGER AS m, CAST(NULL AS DOUBLE) AS e FROM region",
    ),
    "fn_datetime": (
        "SELECT ?y ?m ?d (COUNT(*) AS ?n) WHERE { ?o t:o_orderdate ?t FILTER(?t >= '1997-01-01T00:00:00'^^xsd:dateTime) BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) + HOURS(?t) + MINUTES(?t) + SECONDS(?t) AS ?d) } GROUP BY ?y ?m ?d",
        "SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, (day(o_orderdate) + hour(o_orderdate) + minute(o_orderdate) + second(o_orderdate))::BIGINT AS d, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2, 3",
    ),
    "fn_hash": ("SELECT ?n (MD5(?n) AS ?m) (SHA1(?n) AS ?h) (SHA256(?n) AS ?s) WHERE { ?x t:n_name ?n }", "SELECT n_name AS n, md5(n_name) AS m, sha1(n_name) AS h, sha256(n_name) AS s FROM nation"),
    "fn_if_coalesce": ("SELECT ?d (IF(?n > 1000, 'long', 'short') AS ?len) (COALESCE(?q, -1) AS ?c) WHERE { ?d t:n_chars ?n OPTIONAL { ?d t:quality ?q } }", "SELECT 'urn:t:documents/' || d.doc_id AS d, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS len, coalesce(quality, -1)::INTEGER AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "fn_encode_uri": ("SELECT ?n (ENCODE_FOR_URI(CONCAT(?n, ' & ~*é')) AS ?e) WHERE { ?x t:r_name ?n }", "SELECT r_name AS n, replace(r_name, ' ', '%20') || '%20%26%20~%2A%C3%A9' AS e FROM region"),
    "fn_terms": (
        "SELECT (isIRI(?x) AS ?a) (isLiteral(?n) AS ?b) (isNumeric(?k) AS ?c) (isBlank(?x) AS ?d) (sameTerm(?n, 'ASIA') AS ?e) (STR(DATATYPE(?k)) AS ?f) (LANG(?n) AS ?g) (LANGMATCHES('en-GB', 'en') AS ?h) WHERE { ?x t:r_name ?n ; t:r_regionkey ?k }",
        "SELECT true AS a, true AS b, true AS c, false AS d, r_name = 'ASIA' AS e, 'http://www.w3.org/2001/XMLSchema#integer' AS f, '' AS g, true AS h FROM region",
    ),
    "fn_casts": ("SELECT ?k (xsd:string(?k) AS ?s) (xsd:double(?k) AS ?d) (xsd:boolean('true') AS ?b) (xsd:integer('x') AS ?e) WHERE { ?x t:r_regionkey ?k }", "SELECT r_regionkey AS k, r_regionkey::VARCHAR AS s, r_regionkey::DOUBLE AS d, true AS b, CAST(NULL AS BIGINT) AS e FROM region"),
    "fn_uuid_shape": ("SELECT ?r (REGEX(STR(UUID()), '^urn:uuid:[0-9a-f]{8}-[0-9a-f-]{27}$') AS ?u) (STRLEN(STRUUID()) AS ?n) WHERE { ?x t:r_name ?r }", "SELECT r_name AS r, true AS u, 36::INTEGER AS n FROM region"),
    "fn_make_terms": ("SELECT (IRI(CONCAT('urn:x:', STR(?k))) AS ?i) (isIRI(IRI('urn:a')) AS ?a) (isBlank(BNODE()) AS ?b) (STRDT(?n, xsd:string) AS ?d) WHERE { ?x t:r_regionkey ?k ; t:r_name ?n }", "SELECT 'urn:x:' || r_regionkey AS i, true AS a, true AS b, r_name AS d FROM region"),
    # property paths
    "path_seq": ("SELECT ?o ?r WHERE { ?o t:o_custkey/t:c_nationkey/t:n_regionkey/t:r_name ?r . ?o t:o_orderpriority '5-LOW' }", "SELECT 'urn:t:orders/' || o_orderkey AS o, r_name AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderpriority = '5-LOW'"),
    "path_inverse": ("SELECT ?n (COUNT(?s) AS ?k) WHERE { ?x t:n_name ?n . ?x ^t:s_nationkey ?s } GROUP BY ?n", "SELECT n_name AS n, count(*) AS k FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "path_alt": ("SELECT ?x ?n WHERE { ?x (t:c_nationkey|t:s_nationkey)/t:n_name ?n }", "SELECT 'urn:t:customer/' || c_custkey AS x, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'urn:t:supplier/' || s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "path_plus": ("SELECT ?y WHERE { <urn:t:orders/5> (t:o_custkey|t:c_nationkey|t:n_regionkey)+ ?y }", "SELECT unnest(['urn:t:customer/' || c_custkey, 'urn:t:nation/' || n_nationkey, 'urn:t:region/' || n_regionkey]) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 5"),
    "path_optional": ("SELECT ?y WHERE { <urn:t:nation/5> t:n_regionkey? ?y }", "SELECT unnest(['urn:t:nation/5', 'urn:t:region/' || n_regionkey]) AS y FROM nation WHERE n_nationkey = 5"),
    "path_negated": ("SELECT ?o WHERE { <urn:t:nation/5> !(t:n_name|t:n_nationkey|rdf:type) ?o }", "SELECT 'urn:t:region/' || n_regionkey AS o FROM nation WHERE n_nationkey = 5"),
    "path_plus_seeded": (
        "SELECT ?s ?y WHERE { ?s t:s_name ?n ; t:s_acctbal ?b FILTER(?b > 9000) ?s (t:s_nationkey|t:n_regionkey)+ ?y }",
        "SELECT 'urn:t:supplier/' || s_suppkey AS s, 'urn:t:nation/' || n_nationkey AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000 UNION ALL SELECT 'urn:t:supplier/' || s_suppkey, 'urn:t:region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000",
    ),
    "path_star_backward_seeded": (
        "SELECT ?n (COUNT(?x) AS ?k) WHERE { ?r t:r_name ?n . ?x (t:s_nationkey|t:n_regionkey)* ?r } GROUP BY ?n",
        "SELECT r_name AS n, 1 + count(DISTINCT n_nationkey) + count(s_suppkey) AS k FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    # terms of any kind: under a variable predicate, and in a UNION of unlike columns
    "typed_min_max": (
        "SELECT ?p (MIN(?v) AS ?lo) (MAX(?v) AS ?hi) WHERE { ?s ?p ?v ; t:n_name ?x FILTER(isLiteral(?v)) } GROUP BY ?p",
        "SELECT 'urn:t:n_nationkey' AS p, min(n_nationkey)::VARCHAR AS lo, max(n_nationkey)::VARCHAR AS hi FROM nation UNION ALL SELECT 'urn:t:n_name', min(n_name), max(n_name) FROM nation",
    ),
    "typed_order": ("SELECT ?v WHERE { ?s ?p ?v ; t:n_name ?x FILTER(isNumeric(?v)) } ORDER BY DESC(?v) LIMIT 17", "SELECT n_nationkey::VARCHAR AS v FROM nation ORDER BY n_nationkey DESC LIMIT 17"),
    "typed_compare": (
        "SELECT ?p (COUNT(*) AS ?n) WHERE { ?c ?p ?v ; t:c_mktsegment 'BUILDING' FILTER(?v > 800) } GROUP BY ?p",
        "SELECT 'urn:t:c_custkey' AS p, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 800 HAVING n > 0 UNION ALL SELECT 'urn:t:c_acctbal', count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 800 HAVING n > 0",
    ),
    "typed_time": (
        "SELECT ?p (COUNT(*) AS ?n) (MIN(YEAR(?v)) AS ?y) WHERE { ?o ?p ?v ; t:o_orderstatus 'F' FILTER(?v >= '1996-01-01T00:00:00'^^xsd:dateTime) } GROUP BY ?p",
        "SELECT 'urn:t:o_orderdate' AS p, count(*) AS n, min(year(o_orderdate))::INTEGER AS y FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' HAVING n > 0",
    ),
    "typed_equal": ("SELECT ?p (COUNT(*) AS ?n) WHERE { ?x ?p ?v ; t:p_size ?z FILTER(?v = 7) } GROUP BY ?p", "SELECT * FROM (SELECT 'urn:t:p_partkey' AS p, count(*) AS n FROM part WHERE p_partkey = 7 UNION ALL SELECT 'urn:t:p_size', count(*) FROM part WHERE p_size = 7 UNION ALL SELECT 'urn:t:p_retailprice', count(*) FROM part WHERE p_retailprice = 7) WHERE n > 0"),
    "typed_datatype": (
        "SELECT ?p ?d (COUNT(*) AS ?n) WHERE { ?o ?p ?v ; t:o_orderstatus 'O' BIND(DATATYPE(?v) AS ?d) FILTER(BOUND(?d)) } GROUP BY ?p ?d",
        "SELECT 'urn:t:' || c AS p, 'http://www.w3.org/2001/XMLSchema#' || t AS d, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS n FROM (VALUES ('o_orderkey', 'integer'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'dateTime'), ('o_orderpriority', 'string')) v(c, t)",
    ),
    "typed_constant": ("SELECT ?s ?p WHERE { ?s ?p 17 ; t:p_brand ?b }", "SELECT 'urn:t:part/' || p_partkey AS s, 'urn:t:p_size' AS p FROM part WHERE p_size = 17 UNION ALL SELECT 'urn:t:part/' || p_partkey, 'urn:t:p_partkey' FROM part WHERE p_partkey = 17 UNION ALL SELECT 'urn:t:part/' || p_partkey, 'urn:t:p_retailprice' FROM part WHERE p_retailprice = 17"),
    "typed_union": (
        "SELECT (MIN(?v) AS ?lo) (MAX(?v) AS ?hi) (COUNT(DISTINCT ?v) AS ?n) WHERE { { ?x t:n_nationkey ?v } UNION { ?y t:n_name ?v } UNION { ?z t:o_orderdate ?v } }",
        "SELECT min(n_nationkey)::VARCHAR AS lo, max(n_name) AS hi, 2 * count(*) + (SELECT count(DISTINCT o_orderdate) FROM orders) AS n FROM nation",
    ),
    "typed_union_order": ("SELECT ?v WHERE { { ?x t:n_nationkey ?v } UNION { ?y t:r_name ?v } } ORDER BY ?v OFFSET 12 LIMIT 16", "SELECT v FROM (SELECT n_nationkey::VARCHAR AS v, n_nationkey AS k FROM nation UNION ALL SELECT r_name, 1000 FROM region) ORDER BY k, v LIMIT 16 OFFSET 12"),
    "typed_join": ("SELECT ?p (COUNT(*) AS ?n) WHERE { ?r t:r_regionkey ?v . ?x ?p ?v ; t:p_brand ?b } GROUP BY ?p", "SELECT 'urn:t:p_size' AS p, count(*) AS n FROM part JOIN region ON p_size = r_regionkey HAVING n > 0 UNION ALL SELECT 'urn:t:p_partkey', count(*) AS n FROM part JOIN region ON p_partkey = r_regionkey HAVING n > 0"),
    "typed_language": (
        "SELECT ?n ?l ?d WHERE { ?x t:r_name ?n BIND(IF(?n < 'B', STRLANG(?n, 'en-GB'), STRDT(?n, <urn:dt>)) AS ?v) BIND(LANG(?v) AS ?l) BIND(DATATYPE(?v) AS ?d) FILTER(?n != 'ASIA' || LANGMATCHES(LANG(?v), 'EN')) }",
        "SELECT r_name AS n, CASE WHEN r_name < 'B' THEN 'en-GB' ELSE '' END AS l, CASE WHEN r_name < 'B' THEN 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' ELSE 'urn:dt' END AS d FROM region",
    ),
    # predicates that two maps give to the same subjects
    "shared_predicate": ("SELECT (COUNT(*) AS ?n) (MIN(?d) AS ?lo) WHERE { ?s t:doc_id ?d }", "SELECT count(*) AS n, min(doc_id) AS lo FROM documents"),
    "shared_predicate_filter": ("SELECT ?s ?l WHERE { ?s t:doc_id ?d ; t:lang ?l FILTER(?d < 300) }", "SELECT 'urn:t:documents/' || doc_id AS s, lang AS l FROM documents WHERE doc_id < 300"),
    "shared_predicate_any": (
        "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o ; t:lang 'de' FILTER(?p != t:text) } GROUP BY ?p",
        "WITH d AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'de') SELECT 'urn:t:' || unnest(['doc_id', 'lang', 'source', 'n_chars', 'quality', 'toxic']) AS p, unnest([count(*), count(*), count(*), count(*), count(quality), count(toxic)]) AS n FROM d UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', count(*) + count(quality) FROM d",
    ),
    # as in a store of plain text
    "strings_order": ("SELECT ?x ?k WHERE { ?x t:n_nationkey ?k } ORDER BY ?k LIMIT 12", "SELECT 'urn:t:nation/' || n_nationkey AS x, n_nationkey::VARCHAR AS k FROM nation ORDER BY k LIMIT 12"),
}


def _query(name: str):
    def run(spark, sf_dir):
        graph = tables.graph(spark, sf_dir, strings=name.startswith("strings_"))
        return Engine(spark, graph, tables.PREFIXES).query(PAIRS[name][0])

    return run


def flagship(spark, sf_dir):
    from pyspark.sql import functions as F

    df = Engine(spark, tables.graph(spark, sf_dir), tables.PREFIXES).query(FLAGSHIP)
    return df.select("name", "cnt", F.round("sum", 2).alias("total"))


def _rounded(name: str):
    """Sums of floating numbers, whose last bits depend on the order of summation."""
    from pyspark.sql import functions as F

    base = _query(name)

    def run(spark, sf_dir):
        df = base(spark, sf_dir)
        return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    return run


ROUNDED = {"agg_expression": "mean", "bgp_snowflake": "sq"}

def bgp_self_loop(spark, sf_dir):
    """One variable as subject and object of a pattern: nations whose region has their own number."""
    from .sources.graph import Graph, table_map

    nation = table_map(spark.read.parquet(f"{sf_dir}/nation.parquet"), "urn:t:nation/", "n_nationkey", tables.T, {"n_regionkey": "urn:t:nation/"})
    return Engine(spark, Graph([nation]), tables.PREFIXES).query("SELECT ?x ?n WHERE { ?x t:n_regionkey ?x ; t:n_name ?n }")


def results_document(spark, sf_dir):
    """The JSON results document, read again."""
    import json

    doc = json.loads(Engine(spark, tables.graph(spark, sf_dir), tables.PREFIXES).json("SELECT ?x ?n ?k ?q WHERE { ?x t:n_name ?n ; t:n_nationkey ?k OPTIONAL { ?x t:quality ?q } }"))
    rows = [(b["x"]["type"], b["x"]["value"], b["n"]["value"], b["k"]["value"], b["k"]["datatype"], "q" in b, len(doc["head"]["vars"])) for b in doc["results"]["bindings"]]
    return spark.createDataFrame(rows, "type string, x string, n string, k string, datatype string, q boolean, vars long")


QUERIES = {"flagship": flagship, "bgp_self_loop": bgp_self_loop, "results_document": results_document} | {n: _rounded(n) if n in ROUNDED else _query(n) for n in PAIRS}
ORACLES = {"flagship": "SELECT n_name AS name, count(*) AS cnt, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "bgp_self_loop": "SELECT 'urn:t:nation/' || n_nationkey AS x, n_name AS n FROM nation WHERE n_nationkey = n_regionkey",
    "results_document": "SELECT 'uri' AS type, 'urn:t:nation/' || n_nationkey AS x, n_name AS n, n_nationkey::VARCHAR AS k, 'http://www.w3.org/2001/XMLSchema#integer' AS datatype, false AS q, 4::BIGINT AS vars FROM nation",
} | {
    n: f"SELECT * REPLACE (round({ROUNDED[n]}, 4) AS {ROUNDED[n]}) FROM ({sql})" if n in ROUNDED else sql for n, (_, sql) in PAIRS.items()
}
