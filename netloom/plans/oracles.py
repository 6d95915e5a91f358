"""DuckDB SQL for the queries, written apart from them, over the same derived network."""

from __future__ import annotations

_HEX = "{0}:%02x:%02x:%02x', CAST(floor({1}/65536) AS INT), CAST(floor({1}/256) AS INT)%256, CAST({1}%256 AS INT))"
_CUST = "printf('" + _HEX.format("e4:a7:a0", "c_custkey")
_SUPP = "printf('" + _HEX.format("28:f1:0e", "s_suppkey")

_VIEWS = {
    "sc_ep": f"""SELECT CAST(c_custkey AS BIGINT) pos, printf('%05d', c_custkey) agent_id, CAST(c_nationkey AS INT) nk, c_name hostname,
 CASE WHEN c_custkey%17=0 THEN concat('10.99.',c_nationkey,'.',c_custkey%250+1) ELSE concat('10.0.',c_nationkey,'.',c_custkey%250+1) END ip,
 {_CUST} true_mac, CASE WHEN c_custkey%11<>0 THEN {_CUST} END mac, CASE WHEN c_acctbal<0 THEN 'disconnected' ELSE 'active' END status FROM customer""",
    "sc_dev": """SELECT CAST(n_nationkey AS BIGINT) pos, printf('00:23:ac:e5:00:%02x', n_nationkey) chassis_id, concat('10.0.',n_nationkey,'.254') ip, n_name hostname,
 CASE n_nationkey%5 WHEN 0 THEN '0x28' WHEN 1 THEN '0x20' WHEN 2 THEN '0x08' WHEN 3 THEN '0x10' END cap, n_nationkey%6<>5 pollable, printf('00:23:ac:e5:01:%02x', n_nationkey) own_mac FROM nation
 UNION ALL SELECT 1000+pos, true_mac, NULL, NULL, '0x01', false, NULL FROM sc_ep WHERE pos%13=1""",
    "sc_link": """SELECT CAST(n_nationkey AS BIGINT) seq, printf('00:23:ac:e5:00:%02x', CAST(floor((n_nationkey-1)/2.0) AS INT)) src, printf('00:23:ac:e5:00:%02x', n_nationkey) dst, concat('Te1/',n_nationkey) local_port, 'Gi0/0' remote_port FROM nation WHERE n_nationkey>0
 UNION ALL SELECT 1000+pos, printf('00:23:ac:e5:00:%02x', nk), true_mac, concat('Gi0/',pos%6+1), concat('0x',replace(true_mac,':','')) FROM sc_ep WHERE pos%13=1""",
    "sc_fdb": f"""SELECT nk, true_mac mac, concat('Gi0/', CASE WHEN o_orderkey%4=0 THEN 0 WHEN o_orderkey%5=0 THEN 7 ELSE pos%5+1 END) port, CAST(10*(nk%3+1) AS INT) vlan, CAST(o_orderkey AS BIGINT) seq FROM orders JOIN sc_ep ON o_custkey=pos WHERE o_orderkey%3=0 AND pos%13<>1
 UNION ALL SELECT CAST(s_nationkey AS INT), {_SUPP}, 'Gi0/9', 1, CAST(10000000+s_suppkey AS BIGINT) FROM supplier
 UNION ALL SELECT CAST(n_nationkey AS INT), printf('00:23:ac:e5:01:%02x', n_nationkey), 'Vl1', 1, CAST(20000000+n_nationkey AS BIGINT) FROM nation""",
    "sc_arp": "SELECT pos, true_mac mac, ip FROM sc_ep WHERE pos%22=0",
    "finding": "SELECT printf('%05d', o_custkey) agent_id, printf('CVE-%d-%d', l_orderkey, l_linenumber) cve, round(l_discount*100, 1) cvss FROM lineitem JOIN orders ON l_orderkey=o_orderkey",
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY cvss DESC NULLS LAST, cve) rank FROM finding) WHERE rank<=3",
    # the MAC table and the ladder
    "fdbk": "SELECT printf('00:23:ac:e5:00:%02x', nk) chassis_id, nk, replace(mac,':','') mac, port, vlan, seq FROM sc_fdb",
    "pmc": "SELECT chassis_id, port, count(DISTINCT mac) mac_count FROM fdbk GROUP BY ALL",
    "infra": "SELECT replace(own_mac,':','') mac FROM sc_dev WHERE own_mac IS NOT NULL UNION SELECT replace(chassis_id,':','') FROM sc_dev WHERE pollable",
    "phantom": """SELECT d.chassis_id, d.pos device_pos, e.agent_id, l.src AS "by", l.local_port port FROM sc_dev d JOIN (SELECT * FROM sc_ep WHERE mac IS NOT NULL) e ON replace(d.chassis_id,':','')=replace(e.mac,':','') JOIN sc_link l ON l.dst=d.chassis_id WHERE d.pos>=1000""",
    "stay": "SELECT * FROM sc_dev WHERE chassis_id NOT IN (SELECT chassis_id FROM phantom)",
    "cand": "SELECT f.chassis_id, f.mac, f.port, f.vlan, min(nk) dpos, min(seq) fseq FROM fdbk f WHERE port<>'Gi0/0' AND mac NOT IN (SELECT mac FROM infra) GROUP BY ALL",
    "mt": """SELECT c.mac, a.ip, c.chassis_id, c.port, c.vlan, CASE WHEN n=1 THEN 'resolved' ELSE 'tiebreak' END confidence, c.mpos, c.mseq FROM (SELECT c.*, count(*) OVER (PARTITION BY c.mac) n, row_number() OVER (PARTITION BY c.mac ORDER BY p.mac_count, c.chassis_id, c.port, c.dpos, c.fseq) rn, first_value(c.dpos) OVER (PARTITION BY c.mac ORDER BY c.dpos, c.fseq) mpos, first_value(c.fseq) OVER (PARTITION BY c.mac ORDER BY c.dpos, c.fseq) mseq FROM cand c JOIN pmc p USING (chassis_id, port)) c LEFT JOIN (SELECT replace(mac,':','') mac, ip FROM sc_arp) a USING (mac) WHERE rn=1""",
    "byip": "SELECT ip, mac FROM (SELECT ip, mac, row_number() OVER (PARTITION BY ip ORDER BY mpos DESC, mseq DESC) rn FROM mt WHERE ip IS NOT NULL) WHERE rn=1",
    "gw": "SELECT net, chassis_id gateway FROM (SELECT chassis_id, regexp_extract(ip, '^(.*)\\.', 1) net, row_number() OVER (PARTITION BY regexp_extract(ip, '^(.*)\\.', 1) ORDER BY pollable DESC, pos) rn FROM {0} WHERE ip IS NOT NULL) WHERE rn=1",
    "ladder": """SELECT e.*, CASE WHEN p.agent_id IS NOT NULL THEN 1 WHEN m.mac IS NOT NULL THEN 2 WHEN e.mac IS NULL AND b.mac IS NOT NULL THEN 3 WHEN g.gateway IS NOT NULL THEN 4 ELSE 5 END tier, p.device_pos, p."by" p_by, p.port p_port, m.chassis_id m_at, m.port m_port, m.confidence m_conf, x.chassis_id b_at, x.port b_port, x.confidence b_conf, b.mac b_mac, g.gateway
 FROM sc_ep e LEFT JOIN phantom p USING (agent_id) LEFT JOIN mt m ON m.mac=replace(e.mac,':','') LEFT JOIN byip b ON b.ip=e.ip LEFT JOIN mt x ON x.mac=b.mac LEFT JOIN gw g ON g.net=regexp_extract(e.ip,'^(.*)\\.',1)""",
    "placed": """SELECT concat('endpoint:',agent_id) node_id, CASE tier WHEN 1 THEN 0 ELSE 1 END k, CASE tier WHEN 1 THEN device_pos ELSE pos END o1, CAST(0 AS BIGINT) o2, agent_id,
 CASE tier WHEN 3 THEN regexp_replace(b_mac,'(..)(..)(..)(..)(..)(..)','\\1:\\2:\\3:\\4:\\5:\\6') ELSE mac END mac, ip,
 CASE tier WHEN 1 THEN p_by WHEN 2 THEN m_at WHEN 3 THEN b_at WHEN 4 THEN gateway END parent, CASE tier WHEN 1 THEN p_port WHEN 2 THEN m_port WHEN 3 THEN b_port END port,
 CASE tier WHEN 1 THEN 'lldp' WHEN 2 THEN m_conf WHEN 3 THEN b_conf WHEN 4 THEN 'subnet_fallback' END confidence,
 CASE WHEN tier=5 THEN CASE WHEN status<>'active' THEN 'host_offline_no_l2_evidence' WHEN mac IS NULL THEN 'no_endpoint_mac' ELSE 'mac_absent_from_all_fdb' END END reason, tier=3 enriched FROM ladder""",
    "host": """SELECT concat('host:',regexp_replace(mac,'(..)(..)(..)(..)(..)(..)','\\1:\\2:\\3:\\4:\\5:\\6')) node_id, regexp_replace(mac,'(..)(..)(..)(..)(..)(..)','\\1:\\2:\\3:\\4:\\5:\\6') colon, ip, chassis_id parent, port, mpos, mseq FROM mt
 WHERE mac NOT IN (SELECT replace(chassis_id,':','') FROM stay) AND mac NOT IN (SELECT replace(mac,':','') FROM placed WHERE mac IS NOT NULL) AND mac NOT IN (SELECT mac FROM infra)""",
    "att": "SELECT node_id, k, o1, o2, parent, port, confidence, reason FROM placed UNION ALL SELECT node_id, 2, mpos, mseq, parent, port, 'fdb', NULL FROM host",
    "slink": "SELECT * FROM sc_link WHERE src IN (SELECT chassis_id FROM stay) AND dst IN (SELECT chassis_id FROM stay)",
    # breadth-first over the tree of links; (n - 1) // 2 is the parent of nation n
    "tree": "SELECT CAST(n_nationkey AS BIGINT) pos, printf('00:23:ac:e5:00:%02x', n_nationkey) chassis_id, CAST(floor(log2(n_nationkey+1)) AS INT) depth, CASE WHEN n_nationkey>0 THEN printf('00:23:ac:e5:00:%02x', CAST(floor((n_nationkey-1)/2.0) AS INT)) END parent FROM nation",
    # devices that stay: the tree, and as its leaves the phantoms that nobody claims
    "ranked": """SELECT chassis_id, parent, row_number() OVER (ORDER BY depth, above, seq)-1 rank FROM (
 SELECT chassis_id, parent, depth, CASE WHEN pos=0 THEN -1 ELSE floor((pos-1)/2.0) END above, pos seq FROM tree
 UNION ALL SELECT s.chassis_id, l.src, t.depth+1, t.pos, l.seq FROM stay s JOIN sc_link l ON l.dst=s.chassis_id JOIN tree t ON t.chassis_id=l.src WHERE s.pos>=1000)""",
    "discovered": """SELECT node_id, parent_id, row_number() OVER (ORDER BY loose, rank, k, o1, o2)-1 discovery_order FROM (
 SELECT concat('device:',chassis_id) node_id, CASE WHEN parent IS NOT NULL THEN concat('device:',parent) END parent_id, 0 loose, rank, -1 k, 0 o1, 0 o2 FROM ranked
 UNION ALL SELECT a.node_id, CASE WHEN a.parent IS NOT NULL THEN concat('device:',a.parent) END, CASE WHEN a.parent IS NULL THEN 1 ELSE 0 END, coalesce(r.rank,0), k, o1, o2 FROM att a LEFT JOIN ranked r ON r.chassis_id=a.parent)""",
    "node": """SELECT concat('device:',chassis_id) node_id, 'device' kind, ip, hostname, CAST(NULL AS VARCHAR) mac, 'snmp_lldp' discovery_method, CAST(NULL AS VARCHAR) status, CASE cap WHEN '0x28' THEN 'l3-switch' WHEN '0x20' THEN 'l2-switch' WHEN '0x08' THEN 'router' WHEN '0x10' THEN 'access-point' WHEN '0x01' THEN 'station' ELSE 'Unknown Network Device' END role, CAST(0 AS DOUBLE) risk_score, CAST(NULL AS VARCHAR) agent_id, chassis_id, pollable FROM stay
 UNION ALL SELECT concat('endpoint:',e.agent_id), 'endpoint', e.ip, e.hostname, p.mac, 'wazuh', e.status, CASE WHEN d.cap='0x01' THEN 'station' ELSE 'host' END, coalesce(t.cvss,0), e.agent_id, NULL, NULL FROM sc_ep e JOIN placed p USING (agent_id) LEFT JOIN sc_dev d ON d.chassis_id=e.mac LEFT JOIN top t ON t.agent_id=e.agent_id AND t.rank=1
 UNION ALL SELECT node_id, 'endpoint', ip, NULL, colon, 'snmp_fdb', 'discovered', 'host', NULL, NULL, NULL, NULL FROM host""",
    "edge": """SELECT concat('device:',src) source, concat('device:',dst) target, 'lldp' type, local_port, remote_port, CAST(NULL AS VARCHAR) confidence FROM slink
 UNION ALL SELECT node_id, concat('device:',parent), 'endpoint_link', port, NULL, confidence FROM att WHERE parent IS NOT NULL""",
    # inventory
    "agent": "SELECT c_custkey k, printf('%05d', c_custkey) agent_id, concat('10.',c_nationkey,'.',CAST(floor(c_custkey/250) AS INT)%250,'.',c_custkey%250) ip FROM customer",
    "card": """SELECT k, agent_id, ip, CAST(pos AS INT) pos, CASE WHEN pos=0 AND k%4=0 THEN 'vEthernet 0' ELSE concat('eth',pos) END name,
 concat(CASE WHEN (k+pos)%6=0 THEN '06' ELSE '04' END, printf(':a7:00:%02x:%02x:%02x', CAST(floor(k/256) AS INT)%256, CAST(k%256 AS INT), CAST(pos AS INT))) mac, CASE WHEN (k+pos)%3=0 THEN 'up' ELSE 'down' END state,
 CASE WHEN (k+pos)%7=0 THEN 'ipv6' ELSE 'IPv4' END proto, CASE WHEN (k+pos)%5=0 THEN concat('169.254.1.',pos) WHEN pos=2 THEN ip ELSE concat('172.16.',k%250,'.',pos) END address FROM agent, range(3) t(pos)""",
    "held": "SELECT * FROM card WHERE proto='IPv4' AND address NOT LIKE '169.254.%'",
    # walks
    "bridge": "SELECT nk, seq, vlan, replace(mac,':','') mac, port, CASE WHEN port LIKE 'Gi0/%' THEN CAST(substr(port,5) AS INT)+1 ELSE 99 END bp, CASE WHEN nk%4=1 THEN CAST(vlan AS VARCHAR) ELSE '' END ctx FROM sc_fdb",
    # what build_fdb reads: contexts of operational VLANs, else 802.1Q rows, else flat ones
    "flat": "SELECT * FROM bridge WHERE nk%2=1 UNION ALL SELECT nk, seq, vlan, mac, port, bp, CAST(vlan AS VARCHAR) FROM bridge WHERE nk%8=0 AND vlan<>1",
    "read": """SELECT nk, seq, mac, vlan, bp FROM flat WHERE ctx<>'' AND NOT (nk%4=1 AND vlan=30)
 UNION ALL SELECT nk, seq, mac, vlan, bp FROM bridge WHERE nk%2=0 AND nk NOT IN (SELECT nk FROM flat WHERE nk%2=0)
 UNION ALL SELECT nk, seq, mac, NULL, bp FROM flat WHERE nk%4=3""",
    "switched": "SELECT nk, seq, mac, CASE WHEN bp>10 THEN '99' WHEN nk%5<>0 THEN concat('Gi0/',bp-1) ELSE concat('GigabitEthernet0/',bp-1) END port, vlan FROM read",
    "said": """SELECT seq, src reporter, dst target, local_port, remote_port FROM sc_link UNION ALL SELECT seq+500, dst, src, remote_port, local_port FROM sc_link WHERE seq<1000""",
    "nb": """SELECT d.ip device_ip, CAST(s.seq AS VARCHAR) num, s.local_port, s.target, s.remote_port, t.hostname, t.ip target_ip, t.cap, s.seq FROM said s JOIN sc_dev d ON d.chassis_id=s.reporter AND d.ip IS NOT NULL JOIN sc_dev t ON t.chassis_id=s.target""",
    "sysd": "SELECT pos n, ip, hostname, chassis_id, cap FROM sc_dev WHERE pos<1000 AND pollable",
}
_NEEDS = {
    "sc_dev": ["sc_ep"], "sc_link": ["sc_ep"], "sc_fdb": ["sc_ep"], "sc_arp": ["sc_ep"], "top": ["finding"], "fdbk": ["sc_fdb"], "pmc": ["fdbk"], "infra": ["sc_dev"], "phantom": ["sc_dev", "sc_link"],
    "stay": ["phantom"], "cand": ["fdbk", "infra"], "mt": ["cand", "pmc", "sc_arp"], "byip": ["mt"], "gw": ["stay"], "ladder": ["phantom", "mt", "byip", "gw"], "placed": ["ladder"], "host": ["placed", "stay", "infra"],
    "att": ["placed", "host"], "slink": ["sc_link", "stay"], "ranked": ["stay", "tree", "sc_link"], "discovered": ["ranked", "att"], "node": ["stay", "placed", "top", "host"], "edge": ["slink", "att"], "card": ["agent"], "held": ["card"], "bridge": ["sc_fdb"],
    "flat": ["bridge"], "read": ["flat"], "switched": ["read"],
    "said": ["sc_link"], "nb": ["said", "sc_dev"], "sysd": ["sc_dev"],
}


def _with(*names: str, body: str, gw: str = "stay", **replaced: str) -> str:
    """The views that a body needs, some of them replaced; {was} in a replacement is the view's usual text."""
    order: list[str] = []
    needs = _NEEDS | _CRAWL_NEEDS if replaced else _NEEDS

    def add(name: str) -> None:
        for other in needs.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    views = _VIEWS | {"gw": _VIEWS["gw"].replace("{0}", gw)} | replaced
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in order) + "\n" + body


# The same views over what a crawl from nation 0 finds: below a device that doesn't answer it ends.
_CRAWLED = {
    "reached": "WITH RECURSIVE r AS (SELECT 0 n UNION ALL SELECT CAST(c.n_nationkey AS INT) FROM nation c JOIN r ON c.n_nationkey>0 AND CAST(floor((c.n_nationkey-1)/2.0) AS INT)=r.n WHERE r.n%6<>5) SELECT n FROM r",
    "all_dev": _VIEWS["sc_dev"],
    "all_link": _VIEWS["sc_link"],
    "sc_link": "SELECT * FROM all_link WHERE src IN (SELECT printf('00:23:ac:e5:00:%02x', n) FROM reached WHERE n%6<>5)",
    "sc_dev": """SELECT row_number() OVER (ORDER BY d.pos>=1000, coalesce(r.n, 0), l.src, l.seq)-1 pos, d.chassis_id, d.ip, CASE WHEN d.pollable THEN d.hostname END hostname, d.cap, d.pollable, CASE WHEN d.pollable THEN d.own_mac END own_mac, CASE WHEN d.pollable THEN d.pos END nk
 FROM all_dev d LEFT JOIN reached r ON r.n=d.pos AND d.pos<1000 LEFT JOIN sc_link l ON l.dst=d.chassis_id WHERE r.n IS NOT NULL OR (d.pos>=1000 AND l.seq IS NOT NULL)""",
    "phantom": _VIEWS["phantom"].replace("d.pos>=1000", "d.ip IS NULL"),
    "all_fdb": _VIEWS["sc_fdb"],
    "bridge": _VIEWS["bridge"].replace("sc_fdb", "all_fdb"),
    "fdbk": "SELECT d.chassis_id, d.pos nk, s.mac, s.port, s.vlan, s.seq FROM switched s JOIN sc_dev d ON d.nk=s.nk",
    "cand": _VIEWS["cand"].replace("port<>'Gi0/0'", "NOT (port='Gi0/0' AND chassis_id<>'00:23:ac:e5:00:00')"),
    "sc_arp": _VIEWS["sc_arp"],
}
_CRAWL_NEEDS = {"sc_link": ["all_link", "reached"], "sc_dev": ["all_dev", "reached", "sc_link"], "all_dev": ["sc_ep"], "all_link": ["sc_ep"], "all_fdb": ["sc_ep"], "bridge": ["all_fdb"], "said": ["all_link"], "nb": ["said", "all_dev"], "fdbk": ["switched", "sc_dev"]}


#: Links lead from the smaller place to the larger, each device has one that leads to it at most: a walk down from the others.
_FOREST = """SELECT chassis_id, root FROM (WITH RECURSIVE dev AS (SELECT * FROM sc_dev WHERE {}), lnk AS (SELECT src, dst FROM sc_link WHERE src IN (SELECT chassis_id FROM dev) AND dst IN (SELECT chassis_id FROM dev)),
 walk AS (SELECT pos root, chassis_id FROM dev WHERE chassis_id NOT IN (SELECT dst FROM lnk) UNION ALL SELECT root, dst FROM walk JOIN lnk ON src=chassis_id) SELECT chassis_id, root FROM walk)"""
#: Depth by depth, in each the devices by the one they are reached from, then by the link.
_QUEUE = """SELECT chassis_id, depth, parent, row_number() OVER (ORDER BY depth, above, seq)-1 rank FROM (SELECT chassis_id, parent, depth, CASE WHEN pos=0 THEN -1 ELSE floor((pos-1)/2.0) END above, pos seq FROM tree
 UNION ALL SELECT d.chassis_id, l.src, t.depth+1, t.pos, l.seq FROM sc_dev d JOIN sc_link l ON l.dst=d.chassis_id JOIN tree t ON t.chassis_id=l.src WHERE d.pos>=1000)"""
_SIX = "CASE WHEN pos%20=1 THEN '::' WHEN pos%20=2 THEN '::1' WHEN pos%20=4 THEN printf('ff02::%x',pos) WHEN pos%20=5 THEN '2001:db8::1::2' WHEN pos%3=1 THEN printf('2001:DB8:%X::%x',nk,pos) ELSE printf('fd00:0:0:%x:0:0:0:%x',nk,pos) END"
#: Endpoints with an address of one of both families, and its digits after those of the groups around a gap are spread.
_KEYED = f"""SELECT pos, agent_id, ip, CASE WHEN len(h)>2 THEN NULL WHEN ip LIKE '%:%' THEN concat('6', array_to_string(list_transform(list_concat(l, list_transform(range(8-len(l)-len(r)), lambda i: '0'), r), lambda x: lpad(x,4,'0')), ''))
 ELSE concat('4', array_to_string(list_transform(string_split(ip,'.'), lambda x: printf('%02x', CAST(x AS INT))), '')) END AS key FROM (SELECT *, list_filter(string_split(h[1],':'), lambda x: x<>'') l, CASE WHEN len(h)=2 THEN list_filter(string_split(h[2],':'), lambda x: x<>'') ELSE [] END r FROM
 (SELECT pos, agent_id, ip, string_split(lower(ip),'::') h FROM (SELECT pos, agent_id, CASE WHEN pos%3=0 THEN concat('10.0.',nk,'.',pos%250+1) ELSE {_SIX} END ip FROM sc_ep)))"""
_IP = "concat('10.0.',nk,'.254')"
_BARE = "replace(true_mac,':','')"

ORACLES: dict[str, str] = {
    "mac_canonical": _with("sc_ep", body=f"SELECT pos, {_BARE} mac_key FROM sc_ep"),
    "mac_format": _with("sc_ep", body="SELECT pos, true_mac mac FROM sc_ep"),
    "mac_from_bytes": _with("sc_ep", body=f"SELECT pos, {_BARE} mac_key FROM sc_ep"),
    "mac_rejects_addresses": _with("sc_ep", body="SELECT pos, CAST(NULL AS VARCHAR) mac_key FROM sc_ep"),
    "locally_administered": _with("sc_ep", body='SELECT pos, pos%3<>1 "local" FROM sc_ep'),
    "chassis_normalize": _with("sc_ep", body="SELECT pos, CASE pos%4 WHEN 0 THEN true_mac WHEN 1 THEN concat('core ', lower(hostname)) END chassis_id FROM sc_ep"),
    "same_subnet": _with("sc_ep", body="SELECT pos, ip LIKE '10.0.3.%' near, ip LIKE '10.0.%' wide, false broken FROM sc_ep"),
    "routable_gateway": _with("sc_ep", body="SELECT pos, pos%6>3 routable FROM sc_ep"),
    "capability_decode": _with("sc_dev", body="SELECT pos, CASE cap WHEN '0x28' THEN 'bridge,router' WHEN '0x20' THEN 'bridge' WHEN '0x08' THEN 'router' WHEN '0x10' THEN 'wlan-ap' WHEN '0x01' THEN 'station' ELSE '' END capabilities FROM sc_dev"),
    "device_role": _with("sc_dev", body="SELECT pos, coalesce(r, 'Unknown Network Device') AS role, coalesce(r, 'host') endpoint_role FROM (SELECT pos, CASE cap WHEN '0x28' THEN 'l3-switch' WHEN '0x20' THEN 'l2-switch' WHEN '0x08' THEN 'router' WHEN '0x10' THEN 'access-point' WHEN '0x01' THEN 'station' END r FROM sc_dev)"),
    "neighbor_infrastructure": _with("sc_dev", body="SELECT pos, ip IS NOT NULL with_ip, coalesce(cap IN ('0x28','0x20','0x08','0x10'), false) without_ip FROM sc_dev"),
    "enterprise_number": _with("sysd", body="SELECT ip device_ip, CASE n%3 WHEN 0 THEN '9' WHEN 1 THEN '12356' ELSE '14988' END enterprise FROM sysd"),
    "vendor_model": _with("sysd", body="SELECT ip device_ip, hostname, CASE n%3 WHEN 0 THEN 'Cisco' WHEN 1 THEN 'Fortinet' ELSE 'MikroTik' END vendor, CASE n%3 WHEN 0 THEN concat('C', 2000+n, 'S') WHEN 1 THEN 'FortiGate 100E' END model, CASE WHEN n%3=1 THEN printf('FG%05d', n) END serial, chassis_id mac, chassis_id, cap cap_enabled FROM sysd"),
    "firmware_parse": _with("sysd", body="SELECT ip device_ip, CASE n%3 WHEN 0 THEN concat('12.2(', n, ')SE5') WHEN 1 THEN concat('6.0.', n) END firmware FROM sysd"),
    "vendor_guess": "SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN 'Juniper' WHEN 1 THEN 'Cisco' WHEN 2 THEN 'Fortinet' END vendor FROM part",
    "agent_projection": "SELECT printf('%03d', c_custkey-1) agent_id, c_name hostname, CASE WHEN c_custkey%7<>0 THEN concat('10.',c_nationkey,'.',CAST(floor(c_custkey/250) AS INT)%250,'.',c_custkey%250) END ip, CASE WHEN c_custkey%9<>0 THEN c_mktsegment END vendor, CASE WHEN c_custkey%9<>0 THEN 'OS' END model, CASE WHEN c_custkey%9<>0 THEN concat(c_custkey%4,'.0') END firmware, 'active' status, 'wazuh' discovery_method FROM customer",
    "manager_filter": "SELECT printf('%03d', c_custkey-1) id, c_name AS name FROM customer WHERE c_custkey<>1",
    "serial_clean": "SELECT printf('%05d', c_custkey) agent_id, CASE WHEN c_custkey%5>2 THEN concat('SN', c_custkey) END serial FROM customer",
    "iface_addr_join": _with("held", body="SELECT agent_id, name, address FROM held"),
    "physical_iface": _with("card", body="SELECT agent_id, CAST(pos AS BIGINT) pos, (k+pos)%6<>0 AND name<>'vEthernet 0' physical FROM card"),
    "select_mac": _with("held", body="SELECT agent_id, mac FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY CASE WHEN k%7<>0 AND address=ip THEN 0 ELSE 1 END, CASE WHEN state='up' THEN 0 ELSE 1 END, pos) rn FROM held WHERE (k+pos)%6<>0 AND name<>'vEthernet 0') WHERE rn=1"),
    "topk_cves": _with("top", body="SELECT agent_id, cve, cvss, rank FROM top"),
    "answers_topk": _with("top", body="SELECT agent_id, cve, cvss, rank FROM top"),
    "answers_term": _with("finding", body="SELECT agent_id, cve, cvss FROM finding WHERE cvss>=7"),
    "risk_score": _with("top", body="SELECT agent_id, cvss risk_score FROM top WHERE rank=1"),
    "parse_hit": _with("finding", body="SELECT agent_id, cve, cvss, '3.1' cvss_version, CASE WHEN cvss>=7 THEN 'High' ELSE 'Low' END severity, concat('pkg-', right(cve,1)) package, '1.0' AS version, CAST(NULL AS VARCHAR) description FROM finding"),
    "agent_scored": _with("sc_ep", "top", body="SELECT e.agent_id, coalesce(f.cvss, 0) risk_score, t.rank-1 k, t.cve, CASE WHEN t.cvss>=7 THEN 'High' WHEN t.cve IS NOT NULL THEN 'Low' END severity FROM sc_ep e LEFT JOIN top t USING (agent_id) LEFT JOIN top f ON f.agent_id=e.agent_id AND f.rank=1"),
    "oid_dot1q_decode": _with("bridge", body=f"SELECT {_IP} device_ip, seq, vlan, mac, CAST(bp AS VARCHAR) bridge_port FROM bridge WHERE nk%2=0"),
    "oid_dot1d_decode": _with("flat", body=f"SELECT {_IP} device_ip, ctx context, seq, mac, CAST(bp AS VARCHAR) bridge_port FROM flat"),
    "oid_octet_guard": _with("sc_ep", body="SELECT pos, CASE WHEN pos%3=2 THEN '0102030405ff' END mac FROM sc_ep"),
    "arp_decode": _with("sc_arp", body="SELECT pos seq, replace(mac,':','') mac, ip FROM sc_arp"),
    "mgmt_addr_decode": _with("nb", body="SELECT device_ip, num local_num, target_ip mgmt_ip FROM nb WHERE target_ip IS NOT NULL"),
    "port_resolution": "SELECT concat('10.0.',n_nationkey,'.254') device_ip, CAST(10000+n AS VARCHAR) ifindex, concat(CASE WHEN n_nationkey%5<>0 THEN 'Gi0/' ELSE 'GigabitEthernet0/' END, n-1) AS name FROM nation, range(1,11) t(n)",
    "port_status": "SELECT concat('10.0.',n_nationkey,'.254') device_ip, concat(CASE WHEN n_nationkey%5<>0 THEN 'Gi0/' ELSE 'GigabitEthernet0/' END, n-1) AS port, CASE WHEN n%3=0 THEN 'down' ELSE 'up' END status FROM nation, range(1,11) t(n)",
    "vlan_filter": "SELECT concat('10.0.',n_nationkey,'.254') device_ip, CAST(n*150 AS INT) vlan FROM nation, range(1,11) t(n) WHERE n%4<>3 AND n*150<1002 UNION ALL SELECT concat('10.0.',n_nationkey,'.254'), CAST(v AS INT) FROM nation, (VALUES (1),(10),(20),(30)) t(v) WHERE n_nationkey%8=0 OR (n_nationkey%4=1 AND v<>30)",
    "vlan_names": "SELECT concat('10.0.',n_nationkey,'.254') device_ip, CAST(n*10 AS INT) vlan, CASE WHEN n<>4 THEN concat('vlan',n) ELSE '' END AS name FROM nation, range(1,11) t(n)",
    "own_macs": "SELECT concat('10.0.',n_nationkey,'.254') device_ip, printf('0023ace501%02x', n_nationkey) own_macs FROM nation",
    "build_fdb": _with("switched", body=f"SELECT {_IP} device_ip, seq, mac, port, vlan FROM switched"),
    "build_fdb_stored": _with("switched", body=f"SELECT {_IP} device_ip, seq, mac, port, vlan FROM switched"),
    # an arc of up to 8 bits has two hex digits, one of up to 16 bits four
    "walk_key_range": _with("sc_fdb", body=f"""SELECT *, array_to_string(list_transform(string_split(oid,'.'), lambda a: CASE WHEN a='0' THEN '00' WHEN CAST(a AS INT)<256 THEN printf('01%02x', CAST(a AS INT)) ELSE printf('02%04x', CAST(a AS INT)) END), '') AS key FROM
 (SELECT {_IP} device_ip, concat('1.3.6.1.2.1.17.7.1.2.2.1.2.', vlan, '.', array_to_string(list_transform(string_split(mac,':'), lambda x: CAST(CAST(concat('0x',x) AS INT) AS VARCHAR)), '.')) oid, seq FROM sc_fdb WHERE nk%2=0)"""),
    "mixed_addresses": _with("sc_ep", body=f"""SELECT pos, ip, key, key[1:7] net24, CASE WHEN key[1]='6' THEN concat(key[1:12], printf('%x', CAST(concat('0x',key[13]) AS INT) & 12)) END net46, coalesce(key[1:13]='620010db80003', false) near,
 key IS NOT NULL AND key NOT IN (concat('6',repeat('0',32)), concat('6',repeat('0',31),'1')) AND key NOT LIKE '6ff%' routable FROM ({_KEYED}) k"""),
    "subnet_parent_mixed": _with("sc_ep", "sc_dev", body=f"""SELECT agent_id, d.chassis_id gateway FROM ({_KEYED}) k LEFT JOIN (SELECT chassis_id, CASE WHEN pos%2=0 THEN printf('6fd0000000000%04x', pos) ELSE printf('40a00%02x', pos) END net FROM sc_dev WHERE pos<1000) d ON net=CASE key[1] WHEN '6' THEN key[1:17] ELSE key[1:7] END"""),
    "listed_items": """SELECT row_number() OVER (ORDER BY c_custkey)-1 "at", CAST(c_custkey AS BIGINT) id, concat(c_name, ' "}],[{\\') name, CAST(c_nationkey AS BIGINT) nation FROM customer""",
    "lldp_rem_pivot": _with("nb", body="SELECT device_ip, num local_num, CASE WHEN seq%3=0 THEN '' ELSE remote_port END port_id, concat('port ',remote_port) port_descr, coalesce(hostname,'') sys_name, cap cap_enabled FROM nb"),
    "build_neighbors": _with("nb", body="SELECT device_ip, local_port, target chassis_id, target chassis_mac, CASE WHEN seq%3=0 THEN concat('port ',remote_port) ELSE remote_port END remote_port, hostname sys_name, 'Cisco IOS Software, C2960S Software' sys_descr, target_ip mgmt_ip, cap cap_enabled FROM nb"),
    "uplink_split": _with("nb", body="SELECT device_ip, array_to_string(list_sort(list(DISTINCT local_port)), ',') neighbor_ports, coalesce(array_to_string(list_sort(list(DISTINCT local_port) FILTER (target_ip IS NOT NULL)), ','), '') uplink_ports FROM nb GROUP BY device_ip"),
    "port_mac_count": _with("pmc", body="SELECT * FROM pmc"),
    "infra_macs": _with("infra", body="SELECT mac FROM infra"),
    "mac_table": _with("mt", body="SELECT mac, ip, chassis_id, port, vlan, confidence FROM mt"),
    "mac_by_ip": _with("byip", body="SELECT ip, mac FROM byip"),
    "lldp_phantom_merge": _with("phantom", body='SELECT chassis_id, agent_id, "by", port FROM phantom'),
    "surviving_lldp_edges": _with("slink", body="SELECT seq, src source_chassis_id, dst target_chassis_id, local_port, remote_port FROM slink"),
    "subnet_parent": _with("sc_ep", "sc_dev", "gw", body="SELECT agent_id, gateway FROM sc_ep LEFT JOIN gw ON net=regexp_extract(ip,'^(.*)\\.',1)", gw="sc_dev"),
    "ip_enrichment": _with("placed", body="SELECT agent_id, mac FROM placed WHERE enriched"),
    "host_discovery": _with("host", body="SELECT node_id, ip, parent, port FROM host"),
    "parent_ladder": _with("att", body="SELECT node_id, parent, port, confidence, reason FROM att"),
    "edge_list_named": _with("edge", "node", body="SELECT e.*, coalesce(nullif(s.hostname,''), nullif(s.ip,''), source) source_name, coalesce(nullif(t.hostname,''), nullif(t.ip,''), target) target_name FROM edge e LEFT JOIN node s ON s.node_id=source LEFT JOIN node t ON t.node_id=target"),
    "confidence_hist": _with("att", body="SELECT confidence, count(*) n FROM att WHERE confidence IS NOT NULL GROUP BY 1"),
    "graph_counts": _with("node", "edge", "att", body="SELECT (SELECT count(*) FROM node) nodes, (SELECT count(*) FROM sc_ep) endpoints, (SELECT count(*) FROM stay) devices, (SELECT count(*) FROM host) fdb_discovered_hosts, (SELECT count(*) FROM att WHERE parent IS NULL) unparented_endpoints, (SELECT count(*) FROM slink) lldp_edges, (SELECT count(*) FROM att WHERE parent IS NOT NULL) endpoint_edges"),
    "unparented": _with("placed", body="SELECT p.node_id, e.hostname, p.reason FROM placed p JOIN sc_ep e USING (agent_id) WHERE p.parent IS NULL"),
    "unreachable": _with("sc_dev", body="SELECT chassis_id, ip FROM sc_dev WHERE NOT pollable"),
    "dedupe_links": _with("sc_link", body="""SELECT min(seq) seq, least(src,dst) source_chassis_id, greatest(src,dst) target_chassis_id, CASE WHEN src<=dst THEN a ELSE b END local_port, CASE WHEN src<=dst THEN b ELSE a END remote_port
 FROM (SELECT seq, src, dst, CASE WHEN seq%3=0 THEN 'late' ELSE local_port END a, remote_port b FROM sc_link) GROUP BY ALL"""),
    "components": _with("sc_dev", "sc_link", body=_FOREST.format("pos<>1")),
    "components_all": _with("sc_dev", "sc_link", body=_FOREST.format("true")),
    "bfs_order": _with("tree", "sc_dev", "sc_link", body=_QUEUE),
    "bfs_order_all": _with("tree", "sc_dev", "sc_link", body=_QUEUE),
    "discovery_order": _with("discovered", body="SELECT node_id, parent_id, discovery_order FROM discovered"),
    "node_document": _with("node", "discovered", body="SELECT n.*, d.parent_id FROM node n JOIN discovered d USING (node_id)"),
    "node_json": _with("node", "discovered", body="SELECT node_id, parent_id, true nulls_written, kind='device' is_device_form FROM node JOIN discovered USING (node_id)"),
    "edge_json": _with("edge", body="SELECT source, target, remote_port IS NOT NULL has_remote, confidence IS NOT NULL has_confidence FROM edge"),
    "risk_bucket": _with("sc_ep", "top", body="SELECT e.agent_id, CASE WHEN cvss IS NULL THEN 'unknown' WHEN cvss>=9 THEN 'critical' WHEN cvss>=7 THEN 'high' WHEN cvss>0 THEN 'low' ELSE 'clean' END bucket FROM sc_ep e LEFT JOIN top t ON t.agent_id=e.agent_id AND rank=1"),
    "offline_flag": _with("sc_ep", body="SELECT agent_id, status='disconnected' offline, CASE WHEN pos%2=1 THEN hostname WHEN pos%3<>0 THEN ip ELSE agent_id END AS label FROM sc_ep"),
    "role_icon": _with("sc_dev", body="SELECT pos, CASE cap WHEN '0x28' THEN 'switch' WHEN '0x20' THEN 'switch' WHEN '0x08' THEN 'router' WHEN '0x10' THEN 'wifi' WHEN '0x01' THEN 'monitor' ELSE 'box' END icon, coalesce(hostname, '—') shown FROM sc_dev"),
    "children_semi": _with("discovered", body="SELECT node_id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY discovery_order)-1 sibling_rank FROM discovered WHERE parent_id IN (SELECT node_id FROM discovered)"),
    "node_lookup": _with("node", body="SELECT node_id, hostname, role FROM node WHERE node_id='endpoint:00007'"),
    "duplicate_ips": _with("sc_ep", body="SELECT ip, count(*) n FROM sc_ep GROUP BY ip HAVING count(*)>1"),
    "pollable_backbone": _with("sc_link", "sc_dev", body="SELECT src source_chassis_id, dst target_chassis_id, local_port, remote_port FROM sc_link WHERE src IN (SELECT chassis_id FROM sc_dev WHERE pollable) AND dst IN (SELECT chassis_id FROM sc_dev WHERE pollable)"),
    "network_nodes": _with("sc_dev", body="SELECT chassis_id, ip FROM sc_dev WHERE pollable"),
    "seed_distinct": _with("sc_dev", body="SELECT ip, min(pos) pos FROM sc_dev WHERE ip IS NOT NULL GROUP BY ip"),
    "flagship": _with("node", "discovered", "att", body="SELECT d.discovery_order, n.node_id, kind, hostname, n.ip, mac, role, risk_score, d.parent_id, a.port, a.confidence, a.reason FROM node n JOIN discovered d USING (node_id) LEFT JOIN att a USING (node_id)"),
    "crawl_frontier": _with("sc_dev", body="SELECT chassis_id, ip, CASE WHEN pollable THEN 'online' WHEN ip IS NOT NULL THEN 'unreachable' ELSE 'discovered' END status, pollable, pos FROM sc_dev", **_CRAWLED),
    "crawl_links": _with("sc_link", body="SELECT src source_chassis_id, dst target_chassis_id, local_port FROM sc_link", **_CRAWLED),
    "network_devices": _with("sc_dev", "nb", body="""SELECT d.chassis_id, coalesce(p.neighbor_ports, '') neighbor_ports, coalesce(p.uplink_ports, '') uplink_ports, coalesce(replace(d.own_mac,':',''), '') own_macs, CASE WHEN d.pollable THEN CAST(7 AS BIGINT) END ports_up
 FROM sc_dev d LEFT JOIN (SELECT device_ip, array_to_string(list_sort(list(DISTINCT local_port)), ',') neighbor_ports, array_to_string(list_sort(list(DISTINCT local_port) FILTER (target_ip IS NOT NULL)), ',') uplink_ports FROM nb GROUP BY device_ip) p ON p.device_ip=d.ip AND d.pollable""", **(_CRAWLED | {"said": _VIEWS["said"].replace("sc_link", "all_link"), "nb": _VIEWS["nb"].replace("sc_dev", "all_dev")})),
    "walks_to_graph": _with("node", "att", body="SELECT n.node_id, kind, n.ip, hostname, role, pollable, a.parent, a.port, a.confidence, a.reason FROM node n LEFT JOIN att a USING (node_id)", **_CRAWLED),
    "edge_styles": _with("edge", body="SELECT source, target, nullif(local_port,'') AS label, type='endpoint_link' dashed FROM edge"),
    "detail_rows": _with("node", "stay", "top", body="""SELECT node_id, 'head' section, CAST(k AS BIGINT) "at", ['title','under','risk','offline'][k+1] label,
 [coalesce(nullif(hostname,''), nullif(ip,''), node_id), concat(role, ' · ', discovery_method), CASE WHEN risk_score>=9 THEN 'critical' WHEN risk_score>=7 THEN 'high' WHEN risk_score>0 THEN 'low' ELSE 'clean' END, CASE WHEN status IN ('disconnected','discovered') THEN 'yes' ELSE 'no' END][k+1] "value" FROM node, range(4) r(k) WHERE node_id NOT LIKE 'host:%'
 UNION ALL SELECT node_id, 'identity', k, ['hostname','ip','mac','vendor','model','firmware','serial','role','discovery_method','status'][k+1], coalesce([hostname,ip,mac,NULL,NULL,NULL,NULL,role,discovery_method,status][k+1], '—') FROM node, range(10) r(k) WHERE node_id NOT LIKE 'host:%'
 UNION ALL SELECT concat('endpoint:',agent_id), 'findings', rank-1, cve, concat(CASE WHEN cvss>=7 THEN 'High · ' WHEN cvss>=4 THEN '' ELSE 'Low · ' END, cvss, CASE WHEN cvss>=5 THEN ' (v3.1)' ELSE '' END) FROM top SEMI JOIN sc_ep USING (agent_id)
 UNION ALL SELECT concat('device:',chassis_id), 'ports', 0, 'Gi0/0', 'up' FROM stay WHERE pos%4<>3
 UNION ALL SELECT concat('device:',chassis_id), 'ports', 1, concat('Gi0/',pos%6+1), CASE WHEN pos%2=0 THEN 'up' ELSE 'down' END FROM stay WHERE pos%4<>3
 UNION ALL SELECT concat('device:',chassis_id), 'topology', 0, 'neighbor_ports', CASE WHEN pos%3=0 THEN 'Te1/1, Te1/2' ELSE '—' END FROM stay
 UNION ALL SELECT concat('device:',chassis_id), 'topology', 1, 'uplink_ports', 'Gi0/0' FROM stay"""),
    "toolbar_counts": _with("stay", "edge", body="SELECT (SELECT count(*) FROM stay WHERE pollable) pollable, (SELECT count(*) FROM edge) edges"),
    "tree_depth": _with("discovered", body="SELECT node_id, depth FROM (WITH RECURSIVE r AS (SELECT node_id, CAST(0 AS BIGINT) depth FROM discovered WHERE parent_id IS NULL OR parent_id NOT IN (SELECT node_id FROM discovered) UNION ALL SELECT d.node_id, r.depth+1 FROM discovered d JOIN r ON d.parent_id=r.node_id) SELECT * FROM r)"),
    "route_gateways": """SELECT ip, min(metric) metric, arg_min(seq, metric*1000000+seq) seq FROM (SELECT CASE WHEN s_suppkey%11=0 THEN '127.0.0.1' ELSE concat('10.0.',s_nationkey,'.',s_suppkey%250+1) END ip, CAST(s_suppkey%5*10 AS INT) metric, CAST(s_suppkey AS BIGINT) seq
 FROM supplier WHERE s_suppkey%3=0 AND s_suppkey%7 IN (0,3,6)) WHERE ip<>'127.0.0.1' GROUP BY ip""",
    "seed_texts": """SELECT ip, min(pos) pos FROM (SELECT concat('10.0.',n_nationkey-n_nationkey%5,'.1') ip, CAST(n_nationkey AS BIGINT) pos FROM nation WHERE n_nationkey%5<2
 UNION ALL SELECT concat('10.0.',n_nationkey,'.1'), 1099511627776+n_nationkey FROM nation WHERE n_nationkey%2=0) GROUP BY ip""",
    "addresses_in_text": """SELECT CAST(n_nationkey AS BIGINT) line, CAST(0 AS BIGINT) AS "at", concat('10.0.',n_nationkey-n_nationkey%5,'.1') ip FROM nation WHERE n_nationkey%5<2
 UNION ALL SELECT n_nationkey, i, CASE i WHEN 0 THEN '0.0.0.0' ELSE '127.0.0.1' END FROM nation, range(2) t(i) WHERE n_nationkey%5=2 UNION ALL SELECT n_nationkey, i, concat('10.0.',n_nationkey,CASE i WHEN 0 THEN '.0' ELSE '.7' END) FROM nation, range(2) t(i) WHERE n_nationkey%5=3""",
    "payload_items": "SELECT row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)-1 pos, printf('%03d', c_custkey) id, c_name AS name FROM customer",
    "collected_endpoints": _with("held", body="""SELECT row_number() OVER (ORDER BY a.agent_id)-1 pos, a.agent_id, c_name hostname, CASE WHEN a.k%7<>0 THEN a.ip END ip, CASE WHEN a.k%5>2 THEN concat('SN', a.k) END serial, m.mac FROM agent a JOIN customer ON c_custkey=a.k
 LEFT JOIN (SELECT agent_id, mac FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY CASE WHEN k%7<>0 AND address=ip THEN 0 ELSE 1 END, CASE WHEN state='up' THEN 0 ELSE 1 END, pos) rn FROM held WHERE (k+pos)%6<>0 AND name<>'vEthernet 0') WHERE rn=1) m ON m.agent_id=a.agent_id"""),
}
