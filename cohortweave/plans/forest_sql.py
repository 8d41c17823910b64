"""The forest solver's steps in DuckDB's SQL, many runs at once, to check the registered forest queries.

Inputs are the definitions `fe` (a, b, cost), an undirected network without two ways of equal length, and `fp` (run, node, prize).
A minimum spanning tree of the regions is grown node by node, and gains are passed up until none changes, so these
statements suit some hundreds of nodes; nothing of the library runs through them.
"""

from __future__ import annotations

#: Rank of no edge at all, above that of any edge.
NONE = 1_000_000_000


def forest_sql(omega: float, mu: float) -> list[str]:
    """Definitions down to fedges (run, a, b, cost), fnodes (run, node, prize, p, terminal) and finfo, a summary per run.

    On the way: near, regions of the nearest terminals; grown, their spanning tree; tree, its edges in the network; gains; kept, what pruning keeps.
    """
    return [
        "deg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM fe UNION ALL SELECT b FROM fe) GROUP BY 1)",
        f"pr AS MATERIALIZED (SELECT run, node, prize, prize-{mu}::DOUBLE*degree AS p FROM fp JOIN deg USING (node))",
        "term AS MATERIALIZED (SELECT run, node, p FROM pr WHERE p>0)",
        "arcs AS MATERIALIZED (SELECT a, b, cost FROM fe UNION ALL SELECT b, a, cost FROM fe)",
        # distances and regions: offers of the nodes that changed, until none does
        """near(run, node, dist, seed) USING KEY (run, node) AS (SELECT run, node, 0.0::DOUBLE, node FROM term UNION
(SELECT near.run, arcs.b, min(near.dist+arcs.cost), arg_min(near.seed, near.dist+arcs.cost) FROM near JOIN arcs ON arcs.a=near.node LEFT JOIN recurring.near AS known ON known.run=near.run AND known.node=arcs.b
WHERE known.dist IS NULL OR near.dist+arcs.cost<known.dist-1e-12 GROUP BY near.run, arcs.b))""",
        "via AS MATERIALIZED (SELECT n.run, n.node, arg_min(m.node, m.dist+arcs.cost) AS up, arg_min(arcs.cost, m.dist+arcs.cost) AS cost FROM near n JOIN arcs ON arcs.a=n.node JOIN near m ON m.run=n.run AND m.node=arcs.b WHERE n.dist>0 GROUP BY 1,2)",
        # edges between regions in the order in which a spanning tree takes them
        "met AS (SELECT x.run, x.seed AS sa, y.seed AS sb, x.dist+cost+y.dist AS len, a, b, cost FROM fe JOIN near x ON x.node=a JOIN near y ON y.run=x.run AND y.node=b WHERE x.seed<>y.seed)",
        "pair AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY run, least(sa,sb), greatest(sa,sb) ORDER BY len, a, b)=1)",
        "bridged AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY len, a, b) AS k FROM pair)",
        "two AS MATERIALIZED (SELECT run, sa AS x, sb AS y, k FROM bridged UNION ALL SELECT run, sb, sa, k FROM bridged)",
        # in each step each run adds the region with the cheapest edge to those that it has, or a new tree's first
        f"""grown(run, node, k, comp, done) USING KEY (run, node) AS (SELECT run, node, {NONE}::BIGINT, node, false FROM (SELECT run, x AS node FROM two UNION SELECT run, node FROM term) UNION
(WITH pick AS (SELECT run, arg_min(node, (k, node)) AS node, min(k) AS k, arg_min(comp, (k, node)) AS comp FROM recurring.grown WHERE NOT done AND EXISTS (SELECT 1 FROM grown) GROUP BY run)
SELECT run, node, k, comp, true FROM pick UNION ALL
SELECT pick.run, two.y, two.k, pick.comp, false FROM pick JOIN two ON two.run=pick.run AND two.x=pick.node JOIN recurring.grown AS known ON known.run=pick.run AND known.node=two.y WHERE NOT known.done AND two.k<known.k))""",
        f"taken AS MATERIALIZED (SELECT bridged.* FROM bridged JOIN grown USING (run, k) WHERE k<{NONE})",
        # ways from the taken edges to their terminals
        """walked(run, node) AS (SELECT run, a FROM taken UNION SELECT run, b FROM taken UNION SELECT w.run, via.up FROM walked w JOIN via ON via.run=w.run AND via.node=w.node)""",
        "tree AS MATERIALIZED (SELECT run, a, b, cost FROM taken UNION SELECT via.run, least(node,up), greatest(node,up), via.cost FROM via SEMI JOIN walked USING (run, node))",
        "sides AS MATERIALIZED (SELECT run, a AS x, b AS y, cost FROM tree UNION ALL SELECT run, b, a, cost FROM tree)",
        "home AS MATERIALIZED (SELECT w.run, w.node, g.comp, coalesce(t.p,0.0::DOUBLE) AS net FROM walked w JOIN near USING (run, node) JOIN grown g ON g.run=w.run AND g.node=near.seed LEFT JOIN term t ON t.run=w.run AND t.node=w.node)",
        "roots AS MATERIALIZED (SELECT run, node FROM home QUALIFY row_number() OVER (PARTITION BY run, comp ORDER BY net DESC, node)=1)",
        "below(run, node, parent, cost) AS (SELECT run, node, NULL::VARCHAR, 0.0::DOUBLE FROM roots UNION ALL SELECT s.run, s.y, s.x, s.cost FROM below o JOIN sides s ON s.run=o.run AND s.x=o.node WHERE o.parent IS NULL OR s.y<>o.parent)",
        "steps AS MATERIALIZED (SELECT below.*, net FROM below JOIN home USING (run, node))",
        # gains from the leaves up
        """gains(run, node, gain) USING KEY (run, node) AS (SELECT run, node, CASE WHEN parent IS NULL THEN net ELSE greatest(0.0::DOUBLE, net-cost) END FROM steps UNION
(SELECT u.run, u.node, n.gain FROM (SELECT DISTINCT steps.run, steps.parent AS node FROM gains JOIN steps USING (run, node) WHERE gains.gain>0 AND steps.parent IS NOT NULL) u
JOIN (SELECT o.run, o.node, greatest(0.0::DOUBLE, any_value(o.net)-any_value(o.cost)+sum(g.gain)) AS gain FROM steps o JOIN steps c ON c.run=o.run AND c.parent=o.node JOIN recurring.gains AS g ON g.run=c.run AND g.node=c.node GROUP BY o.run, o.node) n ON n.run=u.run AND n.node=u.node
JOIN recurring.gains AS known ON known.run=u.run AND known.node=u.node WHERE n.gain>known.gain+1e-12))""",
        "kept(run, node, parent, cost) AS (SELECT run, node, NULL::VARCHAR, 0.0::DOUBLE FROM roots UNION ALL SELECT s.run, s.node, s.parent, s.cost FROM kept JOIN steps s ON s.run=kept.run AND s.parent=kept.node JOIN gains ON gains.run=s.run AND gains.node=s.node WHERE gain>0)",
        f"fedges AS MATERIALIZED (SELECT run, least(node,parent) AS a, greatest(node,parent) AS b, cost FROM kept WHERE parent IS NOT NULL AND cost<={omega}::DOUBLE)",
        # single terminals of a component and those worth a tree of their own
        f"""chosen AS (SELECT run, node FROM kept UNION SELECT run, node FROM term WHERE p>{omega}::DOUBLE UNION SELECT run, node FROM term ANTI JOIN two ON two.run=term.run AND two.x=term.node)""",
        "held AS (SELECT run, a AS node FROM fedges UNION SELECT run, b FROM fedges)",
        f"""fnodes AS MATERIALIZED (SELECT c.run, c.node, coalesce(pr.prize,0.0::DOUBLE) AS prize, coalesce(term.p,0.0::DOUBLE) AS p, term.p IS NOT NULL AS terminal FROM chosen c LEFT JOIN pr USING (run, node) LEFT JOIN term USING (run, node) LEFT JOIN held USING (run, node)
WHERE held.node IS NOT NULL OR coalesce(term.p,0)>{omega}::DOUBLE)""",
        f"""finfo AS (SELECT run, nodes, nodes-coalesce(n_edges,0) AS n_trees, terminals, nodes-terminals AS steiner, worth-coalesce(costs,0)-{omega}::DOUBLE*(nodes-coalesce(n_edges,0)) AS objective
FROM (SELECT run, count(*) AS nodes, sum(p) AS worth, count(*) FILTER (terminal) AS terminals FROM fnodes GROUP BY 1) LEFT JOIN (SELECT run, count(*) AS n_edges, sum(cost) AS costs FROM fedges GROUP BY 1) USING (run))""",
    ]
