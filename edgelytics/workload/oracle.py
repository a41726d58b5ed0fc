"""SQL counterparts of the registered queries, written for DuckDB.

They restate each result independently of the Spark code: windows where Spark
aggregates, recursive queries where it loops, explicit label lists where it splits.
"""

from __future__ import annotations

from edgelytics.schema import NEUROTRANSMITTERS
from edgelytics.workload.tables import CONNECTION_COLUMNS, FIRST_LOAD, SECOND_LOAD

_PROBS = ", ".join(column for _, column in NEUROTRANSMITTERS)
_LABELLED = ", ".join(f"('{name}', {i})" for i, (name, _) in enumerate(NEUROTRANSMITTERS))
_NAMES = ", ".join(f"'{name}'" for name, _ in NEUROTRANSMITTERS)


def _labels(score: str) -> str:
    tests = ", ".join(f"case when {c} = {score} then '{name}' end" for name, c in NEUROTRANSMITTERS)
    return f"list_filter([{tests}], lambda x: x is not null)"


def _connections(where: str = "true") -> str:
    columns = ", ".join(CONNECTION_COLUMNS)
    return f"select {columns} from lineitem join orders on l_orderkey = o_orderkey where {where}"


def _gold(source: str) -> str:
    return f"""
      select *, array_to_string(nts, ',') as dominant_nt
      from (select *, {_labels('dominant_score')} as nts
            from (select *, greatest({_PROBS}) as dominant_score from {source}))"""


def _edges(source: str, order: str = "ord") -> str:
    return f"""
      select pre_pt_root_id as src, post_pt_root_id as dst, neuropil, syn_count, {_PROBS},
             dominant_score, dominant_nt, ord
      from (select *, row_number() over (
                partition by pre_pt_root_id, post_pt_root_id, neuropil order by {order} desc) as place
            from {source}
            where pre_pt_root_id is not null and post_pt_root_id is not null and neuropil is not null)
      where place = 1"""


_CTES = {
    "connections": _connections(),
    "gold": _gold("connections"),
    "edges": _edges("gold"),
    # One row per label of each row.
    "labelled": "select g.* , unnest(nts) as nt from gold g",
    # The same with the empty label for rows without any.
    "labelled_all": "select g.*, unnest(case when len(nts) = 0 then [''] else nts end) as nt from gold g",
    "hist": "select syn_count, count(*) as count from gold where syn_count is not null group by all",
    "hist_np": """select neuropil, syn_count, count(*) as count from gold
        where neuropil is not null and syn_count is not null group by all""",
    "hist_np_nt": """select neuropil, nt, syn_count, count(*) as count from labelled
        where neuropil is not null and syn_count is not null group by all""",
    "hist_np_nt_all": """select neuropil, nt, syn_count, count(*) as count from labelled_all
        where neuropil is not null and syn_count is not null group by all""",
    "vocabulary": f"select * from (values {_LABELLED}) as v(nt, rank)",
    "ranked": """select syn_count, row_number() over (order by syn_count) - 1 as place
        from gold where syn_count is not null""",
    "unique_ids": """select count(distinct pre_pt_root_id) as pre_pt_root_id,
        count(distinct post_pt_root_id) as post_pt_root_id,
        (select count(*) from (select pre_pt_root_id as id from connections where id is not null
            union select post_pt_root_id from connections
            where post_pt_root_id is not null)) as neuron_ids_union,
        count(distinct neuropil) as neuropil from connections""",
    "best_label": """select neuropil, nt, pairs from (
        select *, row_number() over (partition by neuropil order by pairs desc, rank) as place
        from (select neuropil, nt, sum(case when syn_count >= {threshold} then count else 0 end)::bigint
                  as pairs from hist_np_nt group by all) join vocabulary using (nt)) where place = 1""",
}

# What each shared subquery reads, in the order they are defined.
_NEEDS = {
    "gold": ["connections"],
    "edges": ["gold"],
    "labelled": ["gold"],
    "labelled_all": ["gold"],
    "hist": ["gold"],
    "hist_np": ["gold"],
    "hist_np_nt": ["labelled"],
    "hist_np_nt_all": ["labelled_all"],
    "ranked": ["gold"],
    "unique_ids": ["connections"],
    "best_label": ["hist_np_nt", "vocabulary"],
}


def _with(names: str, body: str, extra: str = "", recursive: bool = False) -> str:
    """A statement with the named shared subqueries, and those they read, in front."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    parts = [f"{name} as ({_CTES[name]})" for name in wanted] + ([extra] if extra else [])
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {body}"


def _trails(k: int, where: str, downstream: bool, roots: str = "true") -> str:
    """Recursive listing of edge-distinct trails, as text paths in edge direction."""
    near, far = ("src", "dst") if downstream else ("dst", "src")
    score = "coalesce(dominant_score::varchar, 'null')"
    edge = f"'{{' || concat_ws(', ', src, dst, syn_count, neuropil, dominant_nt, {score}) || '}}'"
    key = "concat_ws(':', src, dst, neuropil)"
    nodes = "t.nodes || '>' || u.{0}" if downstream else "u.{0} || '>' || t.nodes"
    steps = "t.edges || ';' || u.step" if downstream else "u.step || ';' || t.edges"
    return f"""
      usable as (select *, {edge} as step, {key} as id from edges where {where}),
      trails as (
        select {near} as root_id, 1 as hops, src || '>' || dst as nodes, step as edges,
               [id] as used, {far} as tip
        from usable where {roots}
        union all
        select t.root_id, t.hops + 1, {nodes.format(far)}, {steps}, list_append(t.used, u.id), u.{far}
        from trails t join usable u on u.{near} = t.tip
        where t.hops < {k} and not list_contains(t.used, u.id))"""


def _nearby(k: int, where: str, roots: str = "true") -> str:
    """Nodes within k undirected hops, root included, one materialised level after another."""
    levels = [f"level_1 as materialized (select distinct a as root_id, b as node_id from both_ways where {roots})"]
    for hop in range(2, k + 1):
        levels.append(
            f"""level_{hop} as materialized (select distinct w.root_id, e.b as node_id
            from level_{hop - 1} w join both_ways e on e.a = w.node_id)"""
        )
    parts = " union ".join(f"select root_id, node_id from level_{hop}" for hop in range(1, k + 1))
    return f"""
      usable as materialized (select * from edges where {where}),
      both_ways as materialized (select src as a, dst as b from usable union select dst, src from usable),
      {", ".join(levels)},
      nearby as materialized ({parts} union select root_id, root_id from level_1)"""


_CIRCUIT = """select n.root_id, u.src as source_root_id, u.dst as target_root_id, u.neuropil,
    u.syn_count, u.dominant_nt
    from usable u join nearby n on n.node_id = u.src
    join nearby m on m.root_id = n.root_id and m.node_id = u.dst"""

_PARTNER = f"syn_count, neuropil, dominant_nt, dominant_score, {_PROBS}"
_TOP = "(select src from edges group by src order by count(*) desc, src limit {0})"
_RAW = f"ord, pre_pt_root_id, post_pt_root_id, neuropil, syn_count, {_PROBS}"
_NARROW = (
    "ord, pre_pt_root_id, post_pt_root_id, neuropil, syn_count, dominant_score, dominant_nt"
)
_SPOILED = ", ".join(
    f"case when {c} = 0.25 then null else {c} end as {c}" for _, c in NEUROTRANSMITTERS
)
_NULLED = (
    f"select ord, pre_pt_root_id, post_pt_root_id, neuropil, syn_count, {_SPOILED} from connections"
)


def _quantile(q: float) -> str:
    index = f"cast(round_even({q} * ((select count(*) from gold) - 1), 0) as bigint)"
    return f"""coalesce((select syn_count from ranked where place = {index}),
        (select max(syn_count) from ranked))"""


def _quantile_rows(quantiles: list[float]) -> str:
    return " union all ".join(
        f"select cast({q} as double) as quantile, {_quantile(q)} as syn_count" for q in quantiles
    )


def _bars(order: str = "syn_count") -> str:
    return f"list({{'syn_count': syn_count, 'count': count}} order by {order})"


def _document(labelled: str, quantiles: list[float]) -> str:
    found = ", ".join(f"{{'key': '{q}', 'value': {_quantile(q)}}}" for q in quantiles)
    as_map = f"map_from_entries([{found}])" if quantiles else "map([]::varchar[], []::integer[])"
    entry = "list({{'key': {0}, 'value': {1}}} order by {0})"
    label = "{'total_pairs': total_pairs, 'histogram': histogram}"
    region = """{'total_pairs': total_pairs, 'histogram': histogram,
        'by_neurotransmitter': by_neurotransmitter}"""
    return f"""
      select to_json({{
        'input': 'connections', 'max_rows': null::bigint,
        'total_rows': (select count(*) from gold),
        'neurotransmitters': [{_NAMES}],
        'unique': (select {{'pre_pt_root_id': pre_pt_root_id, 'post_pt_root_id': post_pt_root_id,
            'neuron_ids_union': neuron_ids_union, 'neuropil': neuropil}} from unique_ids),
        'syn_count': {{'min': (select min(syn_count) from hist), 'max': (select max(syn_count) from hist),
            'median': {_quantile(0.5) if quantiles else 'null::integer'},
            'quantiles': {as_map},
            'histogram': (select {_bars()} from hist)}},
        'by_neuropil': (select map_from_entries({entry.format('neuropil', region)}) from (
            select neuropil, total_pairs, histogram, by_neurotransmitter from (
                select neuropil, sum(count)::bigint as total_pairs, {_bars()} as histogram
                from hist_np group by neuropil)
            left join (select neuropil, map_from_entries({entry.format('nt', label)})
                    as by_neurotransmitter from (
                select neuropil, nt, sum(count)::bigint as total_pairs, {_bars()} as histogram
                from {labelled} group by neuropil, nt) group by neuropil) using (neuropil))),
        'by_neurotransmitter': (select map_from_entries({entry.format('nt', label)}) from (
            select nt, sum(count)::bigint as total_pairs, {_bars()} as histogram
            from (select nt, syn_count, sum(count)::bigint as count from {labelled} group by all)
            group by nt))
      }})::varchar as summary_json"""


_SUMMARY_QUANTILES = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
_ALL_QUANTILES = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
_RAW_DOCUMENT = _with(
    "hist hist_np hist_np_nt ranked unique_ids", _document("hist_np_nt", _SUMMARY_QUANTILES)
)


def _bubbles(threshold: int, nt: str | None) -> str:
    if nt:
        pairs = f"""select n.neuropil, coalesce(sum(h.count), 0)::bigint as pairs
            from (select distinct neuropil from hist_np) n left join hist_np_nt h
            on h.neuropil = n.neuropil and h.nt = '{nt}' and h.syn_count >= {threshold} group by all"""
        best = f"select neuropil, '{nt}' as nt from hist_np group by all"
        label = f"neuropil || '<br>dominant: {nt}<br>pairs ≥ {threshold}: ' || pairs"
    else:
        pairs = f"""select neuropil, sum(case when syn_count >= {threshold} then count else 0 end)::bigint
            as pairs from hist_np group by all"""
        chosen = _CTES["best_label"].format(threshold=threshold)
        best = f"select neuropil, nt from ({chosen})"
        label = f"""neuropil || '<br>pairs ≥ {threshold}: ' || pairs
            || coalesce('<br>dominant: ' || nt, '')"""
    body = f"""
      select neuropil, pairs, nt as dominant_nt,
        case when largest > 0 then 14 + 58 * sqrt(pairs / largest) else 14.0::double end as marker_size,
        case when pairs > 0 then 0.95::double else 0.2::double end as opacity,
        (cell % 10)::integer as grid_x, (cell // 10)::integer as grid_y, {label} as label
      from (select *, max(pairs) over () as largest, row_number() over (order by neuropil) - 1 as cell
            from ({pairs}) left join ({best}) using (neuropil))"""
    return _with("hist_np hist_np_nt vocabulary", body)


def _report(k: int, where: str) -> str:
    root = _TOP.format(1)
    down, up = _trails(3, where, True, f"src = {root}"), _trails(3, where, False, f"dst = {root}")
    up = up.replace("usable as", "usable_up as").replace("trails", "trails_up")
    up = up.replace("from usable ", "from usable_up ").replace("join usable ", "join usable_up ")
    near = _nearby(k, where, f"a = {root}").replace("usable", "usable_c")
    found = {
        "presynaptic": "from trails_up where hops = 1",
        "postsynaptic": "from trails where hops = 1",
        "two_hop_upstream": "from trails_up where hops = 2",
        "two_hop_downstream": "from trails where hops = 2",
        "k_hop_upstream": f"from trails_up where hops <= {k}",
        "k_hop_downstream": f"from trails where hops <= {k}",
        "circuit": f"from ({_CIRCUIT.replace('usable', 'usable_c')})",
    }
    rows = " union all ".join(
        f"select {root} as root_id, '{name}' as section, (select count(*) {source}) as rows"
        for name, source in found.items()
    )
    return _with("edges", rows, f"{down}, {up}, {near}", recursive=True)


def _report_rows(k: int, where: str) -> str:
    root = _TOP.format(1)
    down, up = _trails(k, where, True, f"src = {root}"), _trails(k, where, False, f"dst = {root}")
    up = up.replace("usable as", "usable_up as").replace("trails", "trails_up")
    up = up.replace("from usable ", "from usable_up ").replace("join usable ", "join usable_up ")
    near = _nearby(k, where, f"a = {root}").replace("usable", "usable_c")
    partner = "concat_ws(':', {0}, syn_count, neuropil, dominant_nt) as line from usable_c where {1} = " + root
    chain = f"""concat_ws(':', {{0}}, {{1}}, one.syn_count, two.syn_count, one.neuropil, two.neuropil) as line
        from usable_c one join usable_c two on {{2}} where {{3}} = {root}
        and not (one.src = two.src and one.dst = two.dst and one.neuropil = two.neuropil)"""
    found = {
        "presynaptic": partner.format("src", "dst"),
        "postsynaptic": partner.format("dst", "src"),
        "two_hop_upstream": chain.format("one.src", "two.src", "two.dst = one.src", "one.dst"),
        "two_hop_downstream": chain.format("one.dst", "two.dst", "two.src = one.dst", "one.src"),
        "k_hop_upstream": "nodes as line from trails_up",
        "k_hop_downstream": "nodes as line from trails",
        "circuit": f"""concat_ws(':', source_root_id, target_root_id, neuropil, syn_count, dominant_nt) as line
            from ({_CIRCUIT.replace('usable', 'usable_c')})""",
    }
    rows = " union all ".join(
        f"select {root} as root_id, '{name}' as section, line from (select {line})"
        for name, line in found.items()
    )
    return _with("edges", rows, f"{down}, {up}, {near}", recursive=True)


def _matrix() -> str:
    names = [name for name, _ in NEUROTRANSMITTERS]
    subsets = [[n for i, n in enumerate(names) if mask >> i & 1] for mask in range(2 ** len(names))]
    cells = ", ".join(
        f"count(*) filter (where dominant_nt = '{','.join(s)}') as \"{'_'.join(s) or 'none'}\""
        for s in subsets
    )
    return f"select neuropil, {cells} from gold group by neuropil"


_LATER_LOAD_WINS = f"""with loads as (
      select *, 0 as load from ({_connections(FIRST_LOAD)})
      union all select *, 1 from ({_connections(SECOND_LOAD)})),
    gold as ({_gold('loads')}) {_edges('gold', '(load, ord)')}"""

ORACLE: dict[str, str] = {
    "edges_as_of": f"with loads as ({_connections(FIRST_LOAD)}), gold as ({_gold('loads')}) {_edges('gold')}",
    "scan_ipc": _with(
        "connections",
        f"""select {_RAW.removeprefix('ord, ')}, (row_number() over (partition by pre_pt_root_id,
            post_pt_root_id, neuropil order by ord))::integer as place from connections""",
    ),
    "gold_roundtrip": _with("gold", f"select {_RAW}, dominant_score, dominant_nt from gold"),
    "scan_gold": _with(
        "gold", "select pre_pt_root_id, post_pt_root_id, neuropil, syn_count, dominant_nt from gold"
    ),
    "pairs_by_neuropil": _with(
        "gold",
        """select pre_pt_root_id as pre_id, post_pt_root_id as post_id, syn_count, dominant_nt, neuropil
        from gold where neuropil = 'N_O' and syn_count >= 10 and dominant_nt like '%GABA%'
        and pre_pt_root_id is not null and post_pt_root_id is not null
        order by syn_count desc, pre_id, post_id, neuropil, dominant_nt limit 1000""",
    ),
    "first_n_rows": _with(
        "connections", f"select * from connections order by {_RAW} limit 10000"
    ),
    "row_count": _with("connections", "select count(*) as total_rows from connections"),
    "schema_report": _with(
        "connections",
        f"""select (row_number() over () - 1)::integer as position, column_name,
        case column_type when 'INTEGER' then 'int' when 'VARCHAR' then 'string'
            else lower(column_type) end as data_type,
        (select count(*) from connections) as total_rows
        from (describe {_connections()})""",
    ),
    "edges_table": _with("edges", "select * from edges"),
    "neurons_table": _with(
        "edges", "select src as root_id from edges union select dst from edges"
    ),
    "rejected_connections": _with(
        "connections",
        """select * from connections
        where pre_pt_root_id is null or post_pt_root_id is null or neuropil is null""",
    ),
    "edges_upsert": _LATER_LOAD_WINS,
    "summary_document": _RAW_DOCUMENT,
    "summary_document_gold": _with(
        "hist hist_np hist_np_nt_all ranked unique_ids", _document("hist_np_nt_all", [])
    ),
    "summary_histograms": _with(
        "hist hist_np hist_np_nt",
        """select null::varchar as neuropil, null::varchar as nt, syn_count, count from hist
        union all select neuropil, null, syn_count, count from hist_np
        union all select null, nt, syn_count, sum(count)::bigint from hist_np_nt group by nt, syn_count
        union all select neuropil, nt, syn_count, count from hist_np_nt""",
    ),
    "summary_record": _with(
        "hist ranked unique_ids",
        f"""select 'whole' as dataset_id, 'connections' as input,
        (select count(*) from gold) as total_rows, null::bigint as max_rows, u.*,
        (select min(syn_count) from hist)::bigint as syn_min,
        (select max(syn_count) from hist)::bigint as syn_max,
        {_quantile(0.5)}::bigint as syn_median from unique_ids u""",
    ),
    "summary_fetch": f"select 'whole' as dataset_id, summary_json from ({_RAW_DOCUMENT})",
    "dominant_score": _with("gold", "select ord, pre_pt_root_id, dominant_score from gold"),
    "dominant_nt": _with("gold", "select ord, pre_pt_root_id, dominant_nt from gold"),
    "nt_tokens": _with(
        "gold",
        """select ord, pre_pt_root_id, len(nts)::integer as labels,
        array_to_string(nts, ' + ') as text from gold""",
    ),
    "nt_exploded": _with("labelled", "select ord, pre_pt_root_id, syn_count, nt from labelled"),
    "enriched_no_probs": _with("gold", f"select {_NARROW} from gold"),
    "nan_to_null": _with("connections", _NULLED),
    "nan_counts": _with(
        "connections",
        " union all ".join(
            f"select '{c}' as column_name, count(*) filter (where {c} = 0.25) as nan_rows from connections"
            for _, c in NEUROTRANSMITTERS
        ),
    ),
    "dominant_nan": _with(
        "connections",
        "select ord, pre_pt_root_id, dominant_score, dominant_nt from spoiled_gold",
        f"spoiled as ({_NULLED}), spoiled_gold as ({_gold('spoiled')})",
    ),
    "tied_rows": _with("gold", f"select {_NARROW} from gold where len(nts) > 1"),
    "reweight_silence": _with(
        "edges",
        """select src as source_id, dst as target_id, syn_count as original_syn_count,
        0.0::double as effective_syn_count, neuropil from edges""",
    ),
    "reweight_boost": _with(
        "edges",
        """select src as source_id, dst as target_id, syn_count as original_syn_count,
        coalesce(syn_count, 0) * 2.0::double as effective_syn_count, neuropil from edges""",
    ),
    "reweight_scenarios": _with(
        "edges",
        """select src as source_id, dst as target_id, syn_count as original_syn_count,
        coalesce(syn_count, 0) * ((count(*) over (partition by src)) / 16.0::double)
            as effective_syn_count, neuropil from edges""",
    ),
    **{
        name: _with(
            "edges", f"select src, dst, neuropil, syn_count, dominant_nt from edges where {where}"
        )
        for name, where in {
            "edge_filter_threshold": "syn_count >= 25",
            "edge_filter_neuropil": "syn_count >= 0 and neuropil ilike 'a\\_f' escape '\\'",
            "edge_filter_nt": "syn_count >= 0 and dominant_nt ilike '%gaba%'",
        }.items()
    },
    "hist_slice": _with(
        "hist hist_np hist_np_nt",
        """select 'all' as slice, syn_count, count from hist
        union all select 'label', syn_count, sum(count)::bigint from hist_np_nt
            where nt = 'Serotonin' group by syn_count
        union all select 'region', syn_count, count from hist_np where neuropil = 'R_F'
        union all select 'both', syn_count, count from hist_np_nt
            where neuropil = 'R_F' and nt = 'Serotonin'""",
    ),
    "hist_tail": _with(
        "hist_np_nt",
        """select nt, syn_count, sum(count)::bigint as count from hist_np_nt
        where syn_count >= 30 group by nt, syn_count""",
    ),
    "postsynaptic": _with(
        "edges",
        f"select src as root_id, dst as partner_id, {_PARTNER} from edges where syn_count >= 0",
    ),
    "presynaptic": _with(
        "edges",
        f"""select dst as root_id, src as partner_id, {_PARTNER} from edges
        where syn_count >= 5 and neuropil = 'N_O' and dominant_nt like '%Glutamate%'""",
    ),
    "top_neuron_partners": _with(
        "edges",
        f"""select src as root_id, dst as partner_id, {_PARTNER}, 'post' as side from edges
        where syn_count >= 0 and src = {_TOP.format(1)}
        union all select dst, src, {_PARTNER}, 'pre' from edges
        where syn_count >= 0 and dst = {_TOP.format(1)}""",
    ),
    "top_neuron_preview": _with(
        "edges",
        f"""select src as root_id, dst as partner_id, {_PARTNER} from edges
        where syn_count >= 0 and src = {_TOP.format(1)}
        order by syn_count desc, dst, neuropil limit 5""",
    ),
    "two_hop_upstream": _with(
        "edges",
        """select e1.dst as root_id, e1.src as pre1_id, e2.src as pre2_id, e1.syn_count as syn_count_1,
        e2.syn_count as syn_count_2, e1.neuropil as neuropil_1, e2.neuropil as neuropil_2
        from edges e1 join edges e2 on e2.dst = e1.src
        where e1.syn_count >= 25 and e2.syn_count >= 25
        and e1.dominant_nt ilike '%a%' and e2.dominant_nt ilike '%a%'
        and not (e1.src = e2.src and e1.dst = e2.dst and e1.neuropil = e2.neuropil)""",
    ),
    "two_hop_downstream": _with(
        "edges",
        """select e1.src as root_id, e1.dst as post1_id, e2.dst as post2_id, e1.syn_count as syn_count_1,
        e2.syn_count as syn_count_2, e1.neuropil as neuropil_1, e2.neuropil as neuropil_2
        from edges e1 join edges e2 on e2.src = e1.dst
        where e1.syn_count >= 25 and e2.syn_count >= 25
        and not (e1.src = e2.src and e1.dst = e2.dst and e1.neuropil = e2.neuropil)""",
    ),
    "k_hop_downstream": _with(
        "edges",
        "select root_id, hops, nodes, edges from trails",
        _trails(3, "syn_count >= 44", True),
        recursive=True,
    ),
    "k_hop_upstream": _with(
        "edges",
        "select root_id, hops, nodes, edges from trails",
        _trails(3, "syn_count >= 30 and dominant_nt ilike '%dopa%'", False),
        recursive=True,
    ),
    "k_hop_from_top": _with(
        "edges",
        "select root_id, hops, nodes, edges from trails",
        _trails(3, "syn_count >= 25", True, f"src in {_TOP.format(3)}"),
        recursive=True,
    ),
    "paths_between": _with(
        "edges",
        f"""select root_id, hops, nodes, edges, tip as target_id from trails
        where tip in (select dst from edges group by dst order by count(*) desc, dst limit 3)""",
        _trails(4, "syn_count >= 25", True, f"src in {_TOP.format(3)}"),
        recursive=True,
    ),
    "path_preview": _with(
        "edges",
        """select root_id, hops, tip as start, root_id as "end", (hops + 1)::integer as nodes,
        hops as edges from trails""",
        _trails(2, "syn_count >= 40", False),
        recursive=True,
    ),
    "k_hop_nodes": _with(
        "edges",
        "select root_id, node_id from nearby",
        _nearby(2, "syn_count >= 40"),
        recursive=True,
    ),
    "circuit": _with("edges", _CIRCUIT, _nearby(3, "syn_count >= 48")),
    "circuit_document": _with(
        "edges",
        f"""select root_id, ((source_root_id + target_root_id) % 4)::integer as piece,
            to_json({{'circuits': [{{'connections': list({{
            'source_root_id': source_root_id, 'target_root_id': target_root_id, 'neuropil': neuropil,
            'syn_count': syn_count, 'dominant_nt': dominant_nt}}
            order by source_root_id, target_root_id, neuropil)}}]}})::varchar as document
        from ({_CIRCUIT}) group by all""",
        _nearby(1, "syn_count >= 40 and neuropil = 'A_F'"),
    ),
    "outgoing_edges": _with(
        "edges", "select src as source_id, dst as target_id, syn_count, neuropil from edges"
    ),
    "dataset_pairs": _with(
        "edges",
        """select src as pre_id, dst as post_id, syn_count, dominant_nt, neuropil from edges
        where syn_count >= 1 and dominant_nt like '%Serotonin%'
        order by syn_count desc, src, dst, neuropil limit 1000""",
    ),
    "neuron_report_counts": _report(3, "syn_count >= 25"),
    "neuron_report_rows": _report_rows(3, "syn_count >= 40"),
    "out_degree": _with("edges", "select src as root_id, count(*) as out_deg from edges group by src"),
    "top_out_degree": _with(
        "edges",
        """select src as root_id, count(*) as out_deg from edges group by src
        order by out_deg desc, src limit 1""",
    ),
    "graph_counts": _with(
        "edges",
        """select (select count(*) from edges) as edges,
        (select count(*) from (select src from edges union select dst from edges)) as neurons""",
    ),
    "unique_counts": _with("unique_ids", "select * from unique_ids"),
    "approx_unique_counts": _with(
        "unique_ids", "select name, exact, true as close from (unpivot unique_ids on * into name name value exact)"
    ),
    "hist_global": _with("hist", "select * from hist"),
    "hist_by_neuropil": _with(
        "hist_np",
        "select *, (sum(count) over (partition by neuropil))::bigint as total_pairs from hist_np",
    ),
    "hist_by_neuropil_nt": _with(
        "hist_np_nt",
        "select *, (sum(count) over (partition by neuropil, nt))::bigint as total_pairs from hist_np_nt",
    ),
    "hist_by_neuropil_nt_all": _with("hist_np_nt_all", "select * from hist_np_nt_all"),
    "hist_by_nt": _with(
        "labelled",
        """select nt, syn_count, count(*) as count,
        (sum(count(*)) over (partition by nt))::bigint as total_pairs
        from labelled where neuropil is not null and syn_count is not null group by nt, syn_count""",
    ),
    "hist_merge": _with(
        "gold", "select neuropil, dominant_nt, syn_count, count(*) as count from gold group by all"
    ),
    "syn_stats": _with(
        "connections", "select min(syn_count) as syn_min, max(syn_count) as syn_max from connections"
    ),
    "syn_quantiles": _with("ranked", _quantile_rows(_ALL_QUANTILES)),
    "syn_cdf": _with(
        "hist",
        """select a.syn_count, a.count, sum(b.count)::bigint as running
        from hist a join hist b on b.syn_count <= a.syn_count group by all""",
    ),
    "connections_per_neuropil": _with(
        "connections", "select neuropil, count(*) as connections from connections group by neuropil"
    ),
    "dominant_nt_distribution": _with(
        "gold", "select dominant_nt, count(*) as connections from gold group by dominant_nt"
    ),
    "avg_dominant_score": _with(
        "gold",
        "select dominant_nt, round(avg(dominant_score), 9) as avg_score from gold group by dominant_nt",
    ),
    "neuropil_nt_matrix": _with("gold", _matrix()),
    "neuropil_nt_counts": _with(
        "gold", "select neuropil, dominant_nt, count(*) as connections from gold group by all"
    ),
    "tail_total": _with(
        "connections", "select count(*) as pairs from connections where syn_count >= 30"
    ),
    "tail_by_neuropil": _with(
        "hist_np",
        """select a.*, (select sum(b.count)::bigint from hist_np b
            where b.neuropil = a.neuropil and b.syn_count >= a.syn_count) as at_or_above
        from hist_np a""",
    ),
    "tail_by_neuropil_nt": _with(
        "hist_np_nt",
        """select a.*, (select sum(b.count)::bigint from hist_np_nt b where b.neuropil = a.neuropil
            and b.nt = a.nt and b.syn_count >= a.syn_count) as at_or_above
        from hist_np_nt a""",
    ),
    "tail_lookup": _with(
        "hist_np_nt",
        """select neuropil, nt, sum(case when syn_count >= 42 then count else 0 end)::bigint as pairs
        from hist_np_nt group by all""",
    ),
    "region_dominant_nt": _with(
        "hist_np_nt vocabulary", _CTES["best_label"].format(threshold=35)
    ),
    "region_bubbles": _bubbles(20, None),
    "region_bubbles_nt": _bubbles(20, "Dopamine"),
    "incremental_histogram": _with(
        "gold", "select neuropil, dominant_nt, syn_count, count(*) as count from gold group by all"
    ),
    "incremental_edges": _LATER_LOAD_WINS,
}
