"""Read queries over the test tables in the dialect that the engine takes, with the SQL of the check where it differs."""

#: name: (SQL, DuckDB SQL or None if it is the same, parameters)
READS: dict[str, tuple[str, str | None, tuple]] = {
    "scan_all": (
        'select * from nation',
        None,
        (),
    ),
    "filter_eq": (
        'SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = ?',
        "select o_orderkey, o_totalprice from orders where o_orderstatus = 'O'",
        ('O',),
    ),
    "point_lookup": (
        'SELECT * FROM orders WHERE o_orderkey = ?',
        'select * from orders where o_orderkey = 5',
        (5,),
    ),
    "filter_and_range": (
        "select o_orderkey from orders where o_orderpriority='1-URGENT' and o_totalprice>1000.0",
        None,
        (),
    ),
    "range_scan_limit": (
        'SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= ? AND o_orderkey < ? ORDER BY o_orderkey LIMIT ?',
        'select o_orderkey, o_totalprice from orders where o_orderkey >= 100 and o_orderkey < 600 order by o_orderkey limit 500',
        (100, 600, 500),
    ),
    "in_list": (
        'SELECT * FROM customer WHERE c_custkey IN (?, ?, ?)',
        'select * from customer where c_custkey in (1, 3, 5)',
        (1, 3, 5),
    ),
    "in_subquery": (
        'select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey=3)',
        None,
        (),
    ),
    "keyset_page": (
        'SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (CAST(? AS TIMESTAMP), ?) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT ?',
        "select o_orderkey,o_orderdate from orders where (o_orderdate,o_orderkey)<(timestamp'1996-01-01 00:00:00',5000) order by o_orderdate desc,o_orderkey desc limit 50",
        ('1996-01-01 00:00:00', 5000, 50),
    ),
    "feed_topk": (
        'select o_orderkey,o_custkey,o_orderdate from orders order by o_orderdate desc,o_orderkey desc limit 50',
        None,
        (),
    ),
    "join_topk": (
        'select o.o_orderkey,o.o_orderdate,c.c_name from orders o join customer c on c.c_custkey=o.o_custkey where c.c_nationkey=3 order by o.o_orderdate desc,o.o_orderkey desc limit 20',
        None,
        (),
    ),
    "count_star": (
        'select count(*) as cnt from orders',
        None,
        (),
    ),
    "count_tagged": (
        "SELECT COUNT(*) AS cnt, '7' AS sid FROM orders",
        "select count(*) as cnt,'7' as sid from orders",
        (),
    ),
    "case_expr": (
        "select o_orderkey, case o_orderstatus when 'O' then 1 else 0 end as open from orders",
        None,
        (),
    ),
    "cte_chain": (
        'with c as (select * from customer where c_acctbal>0) select c.c_custkey,count(*) as n from c join orders o on o.o_custkey=c.c_custkey group by c.c_custkey',
        None,
        (),
    ),
    "json_each_in": (
        'SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT value FROM json_each(?))',
        'select c_custkey, c_name from customer where c_custkey in (1, 3, 5)',
        ('[1,3,5]',),
    ),
    "json_rows": (
        "SELECT json_extract(value, '$[0]') AS name, json_extract(value, '$[1]') AS email, key FROM json_each(?)",
        "select * from (values ('a', 'b', 0), ('c', 'd', 1)) t(name, email, key)",
        ('[["a","b"],["c","d"]]',),
    ),
    "json_encode": (
        "SELECT json_object('r_regionkey', r_regionkey, 'r_name', nullif(r_name, 'ASIA')) AS j, json_array(r_regionkey, r_name, NULL) AS a FROM region",
        "select json_object('r_regionkey', r_regionkey, 'r_name', nullif(r_name, 'ASIA'))::varchar as j, json_array(r_regionkey, r_name, null)::varchar as a from region",
        (),
    ),
    "blob_base64": (
        'select r_regionkey,base64(cast(r_name as binary)) as b from region',
        'select r_regionkey,base64(r_name::blob) as b from region',
        (),
    ),
    "fk_violations": (
        'select count(*) as bad from orders o left anti join customer c on c.c_custkey=o.o_custkey',
        'select count(*) as bad from orders o where not exists (select 1 from customer c where c.c_custkey=o.o_custkey)',
        (),
    ),
    "unique_violations": (
        'select o_custkey,count(*) as n from orders group by o_custkey having count(*)>1',
        None,
        (),
    ),
    "left_join": (
        'select c.c_custkey,o.o_orderkey from customer c left join orders o on o.o_custkey=c.c_custkey and o.o_totalprice>200000',
        None,
        (),
    ),
    "full_join": (
        'select a.n_nationkey as x,b.s_suppkey as y from nation a full join supplier b on a.n_nationkey=b.s_nationkey',
        None,
        (),
    ),
    "cross_join": (
        'select r_name,n_name from region cross join nation',
        None,
        (),
    ),
    "theta_join": (
        'select a.n_nationkey as x,b.n_nationkey as y from nation a join nation b on a.n_nationkey<b.n_nationkey',
        None,
        (),
    ),
    "semi_exists": (
        "select c_custkey from customer c where exists(select 1 from orders o where o.o_custkey=c.c_custkey and o.o_orderstatus='F')",
        None,
        (),
    ),
    "anti_not_exists": (
        "select c_custkey from customer c where not exists(select 1 from orders o where o.o_custkey=c.c_custkey and o.o_orderstatus='F' and o.o_totalprice>200000)",
        None,
        (),
    ),
    "group_agg": (
        'select l_returnflag,l_linestatus,count(*) as n,round(sum(l_quantity),2) as q,round(avg(l_extendedprice),4) as a,min(l_shipdate) as mn,max(l_shipdate) as mx from lineitem group by l_returnflag,l_linestatus',
        None,
        (),
    ),
    "agg_filter": (
        "select count(*) filter (where o_orderstatus='F') as f,count(distinct o_custkey) as d from orders",
        None,
        (),
    ),
    "total_empty": (
        'SELECT total(o_totalprice) AS total, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 0',
        'select coalesce(sum(o_totalprice),0.0::double) as total, sum(o_totalprice) as s from orders where o_orderkey<0',
        (),
    ),
    "group_concat": (
        "SELECT n_regionkey, length(group_concat(n_name)) AS l, length(group_concat(n_name, ' | ')) AS m FROM nation GROUP BY n_regionkey",
        "select n_regionkey, length(string_agg(n_name, ','))::integer as l, length(string_agg(n_name, ' | '))::integer as m from nation group by n_regionkey",
        (),
    ),
    "distinct": (
        'select distinct o_orderstatus,o_orderpriority from orders',
        None,
        (),
    ),
    "union_all": (
        'select n_nationkey as k from nation union all select s_nationkey from supplier',
        None,
        (),
    ),
    "union": (
        'select n_nationkey as k from nation union select s_nationkey from supplier',
        None,
        (),
    ),
    "intersect": (
        'select n_nationkey as k from nation intersect select c_nationkey from customer',
        None,
        (),
    ),
    "except": (
        "select c_custkey as k from customer except select o_custkey from orders where o_orderstatus='F' and o_totalprice>200000",
        None,
        (),
    ),
    "scalar_subquery": (
        'select c_custkey,(select max(o_totalprice) from orders o where o.o_custkey=c.c_custkey) as m from customer c',
        None,
        (),
    ),
    "recursive_cte": (
        'with recursive r(n) as (select 1 union all select n+1 from r where n<50) select n from r',
        None,
        (),
    ),
    "win_rank": (
        'select o_orderkey,cast(row_number() over w as bigint) as rn,cast(rank() over w as bigint) as rk,cast(dense_rank() over w as bigint) as dr from orders window w as (partition by o_custkey order by o_orderdate,o_orderkey)',
        'select o_orderkey,row_number() over w as rn,rank() over w as rk,dense_rank() over w as dr from orders window w as (partition by o_custkey order by o_orderdate,o_orderkey)',
        (),
    ),
    "win_lag_lead": (
        'select o_orderkey,lag(o_totalprice) over w as p,lead(o_totalprice,1) over w as nx,first_value(o_totalprice) over w as f from orders window w as (partition by o_custkey order by o_orderdate,o_orderkey)',
        None,
        (),
    ),
    "win_frame": (
        'select o_orderkey,round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate,o_orderkey rows between 2 preceding and current row),2) as s3 from orders',
        None,
        (),
    ),
    "win_ntile": (
        'SELECT c_custkey, CAST(ntile(4) OVER w AS bigint) AS nt, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)',
        'select c_custkey, ntile(4) over w as nt, percent_rank() over w as pr, cume_dist() over w as cd from customer window w as (partition by c_nationkey order by c_custkey)',
        (),
    ),
    "string_fns": (
        "select n_nationkey,upper(n_name) as u,lower(n_name) as l,cast(length(n_name) as bigint) as len,substr(n_name,2,3) as sb,trim(n_name) as t,replace(n_name,'A','x') as rp,cast(instr(n_name,'A') as bigint) as ix,n_name||'!' as cc from nation",
        "select n_nationkey,upper(n_name) as u,lower(n_name) as l,length(n_name) as len,substr(n_name,2,3) as sb,trim(n_name) as t,replace(n_name,'A','x') as rp,instr(n_name,'A') as ix,n_name||'!' as cc from nation",
        (),
    ),
    "like_ci": (
        "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1-urg%'",
        "select o_orderkey from orders where o_orderpriority ilike '1-urg%'",
        (),
    ),
    "math_fns": (
        'select o_orderkey,abs(o_totalprice) as a,round(o_totalprice,1) as r,floor(o_totalprice) as f,sqrt(o_totalprice) as sq,o_orderkey%7 as m from orders',
        'select o_orderkey,abs(o_totalprice) as a,round(o_totalprice,1) as r,floor(o_totalprice)::bigint as f,sqrt(o_totalprice) as sq,o_orderkey%7 as m from orders',
        (),
    ),
    "int_div": (
        'select o_orderkey,o_orderkey div 7 as d from orders',
        'select o_orderkey,o_orderkey//7 as d from orders',
        (),
    ),
    "date_fns": (
        "SELECT o_orderkey, strftime('%Y', o_orderdate) AS y, date(o_orderdate, '+1 month') AS nx, date(o_orderdate, 'start of month', '-1 day') AS p, unixepoch(o_orderdate) AS u, julianday(o_orderdate) AS j, date(o_orderdate, 'weekday 0') AS w FROM orders",
        "select o_orderkey, strftime(o_orderdate, '%Y') as y, strftime(o_orderdate + interval 1 month, '%Y-%m-%d') as nx, strftime(date_trunc('month', o_orderdate) - interval 1 day, '%Y-%m-%d') as p, epoch(o_orderdate)::bigint as u, epoch(o_orderdate) / 86400 + 2440587.5 as j, strftime(o_orderdate + to_days(((7 - dayofweek(o_orderdate)) % 7)::int), '%Y-%m-%d') as w from orders",
        (),
    ),
    "null_fns": (
        "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, o_orderstatus IS NULL AS n, ifnull(nullif(o_orderstatus, 'O'), 'x') AS i, iif(o_orderstatus = 'F', 1, 0) AS f, max(o_orderkey, 100) AS m, typeof(o_totalprice) || typeof(o_orderkey) || typeof(o_orderstatus) || typeof(nullif(1, 1)) AS t FROM orders",
        "select o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') as c, o_orderstatus is null as n, ifnull(nullif(o_orderstatus, 'O'), 'x') as i, if(o_orderstatus = 'F', 1, 0) as f, greatest(o_orderkey, 100) as m, 'realintegertextnull' as t from orders",
        (),
    ),
    "json_extract": (
        "SELECT event_id, json_extract(props, '$.k') AS k, props ->> 'k' AS a, props -> '$.k' AS b, json_valid(props) AS v FROM events",
        "select event_id, props->>'$.k' as k, props->>'$.k' as a, (props->'$.k')::varchar as b, json_valid(props) as v from events",
        (),
    ),
    "nulls_first_topk": (
        'select nullif(c_nationkey,3) as k,c_custkey from customer order by k,c_custkey limit 30',
        'select nullif(c_nationkey,3) as k,c_custkey from customer order by k nulls first,c_custkey limit 30',
        (),
    ),
    "filter_blob": (
        'SELECT c_custkey FROM customer WHERE CAST(c_mktsegment AS BLOB) = ?',
        "select c_custkey from customer where c_mktsegment = 'BUILDING'",
        (b'BUILDING',),
    ),
    "offset_page": (
        'SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT ? OFFSET ?',
        'select o_orderkey from orders order by o_orderkey limit 20 offset 40',
        (20, 40),
    ),
    "json_edit": (
        "SELECT r_regionkey, json_set(json_object('a', r_regionkey), '$.b', r_name) AS s, json_insert(json_object('a', 1), '$.a', 2) AS i, json_replace(json_object('a', 1), '$.a', 2) AS r, json_remove(json_object('a', 1, 'b', 2), '$.a') AS x FROM region",
        'select r_regionkey, to_json({\'a\': r_regionkey, \'b\': r_name})::varchar as s, \'{"a":1}\' as i, \'{"a":2}\' as r, \'{"b":2}\' as x from region',
        (),
    ),
    "json_group": (
        'SELECT n_regionkey, json_array_length(json_group_array(n_name)) AS n, length(json_group_object(n_name, n_nationkey)) AS c FROM nation GROUP BY n_regionkey',
        'select n_regionkey, count(*)::integer as n, (1 + sum(length(n_name) + length(n_nationkey::varchar) + 4))::integer as c from nation group by n_regionkey',
        (),
    ),
    "glob": (
        "SELECT n_nationkey FROM nation WHERE n_name GLOB '*A?[A-N]*' OR n_name GLOB 'nation_1*'",
        "select n_nationkey from nation where n_name glob '*A?[A-N]*' or n_name glob 'nation_1*'",
        (),
    ),
    "is_value": (
        'SELECT c_custkey, nullif(c_nationkey, 3) IS 4 AS a, nullif(c_nationkey, 3) IS NOT 4 AS b, nullif(c_nationkey, 3) IS nullif(3, 3) AS c FROM customer',
        'select c_custkey, nullif(c_nationkey, 3) is not distinct from 4 as a, nullif(c_nationkey, 3) is distinct from 4 as b, nullif(c_nationkey, 3) is null as c from customer',
        (),
    ),
    "between_not_in": (
        "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN ? AND ? AND o_orderstatus NOT IN ('F')",
        "select o_orderkey from orders where o_totalprice between 1000 and 90000 and o_orderstatus not in ('F')",
        (1000, 90000),
    ),
    "having": (
        'SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > ?',
        'select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12',
        (12,),
    ),
    "right_join": (
        'SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON s_nationkey = n_nationkey AND n_regionkey = 1',
        None,
        (),
    ),
    "join_using": (
        'SELECT n_nationkey, r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM region) JOIN (SELECT n_regionkey AS k, n_nationkey, n_name FROM nation) USING (k)',
        None,
        (),
    ),
    "natural_join": (
        'SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey AS y FROM supplier)',
        None,
        (),
    ),
    "win_values": (
        'SELECT o_orderkey, last_value(o_totalprice) OVER w AS l, nth_value(o_totalprice, 2) OVER w AS n2, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)',
        None,
        (),
    ),
    "cast_types": (
        "SELECT o_orderkey, CAST(o_orderkey AS TEXT) AS t, CAST('12' AS INTEGER) + o_orderkey AS i, CAST(o_orderkey AS REAL) AS r FROM orders",
        'select o_orderkey, o_orderkey::varchar as t, 12 + o_orderkey as i, o_orderkey::double as r from orders',
        (),
    ),
    "quoted_names": (
        'SELECT "o_orderkey" AS [the key], `o_custkey` AS "a ""b""" FROM orders WHERE o_orderstatus == \'F\'',
        'select o_orderkey as "the key", o_custkey as "a ""b""" from orders where o_orderstatus = \'F\'',
        (),
    ),
}
