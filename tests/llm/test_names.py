from legajo.llm import names as N

NODES = [("p1", "María Luisa Quintósteo Ventutre", "person", 1), ("p2", "Dolores Jovomil Tarvecina", "person", None), ("p3", "Daniel Jovomil Argides", "person", 2), ("p4", "José Argarrés Kermecina", "person", 2), ("o1", "Clínica Comarcal de Quintedra", "organization", 1), ("o2", "Consorcio Naval Lodromil S.A.", "organization", 1), ("o3", "Talleres y Montajes Yebusa S.L.", "organization", 0), ("x", None, "person", 0)]
MEANT = {
    "person": {"M.L. Quintósteo Ventutre": "p1", "QUINTÓSTEO, María Luisa": "p1", "Mª Luisa Quintósteo": "p1", "maria luisa quintosteo ventutre ": "p1", "Lola Jovomil": "p2", "Dr/a. Dolores Jovomil": "p2", "Jovomil Tarvecina, D.": "p2", "Dolores Jovomil T.": "p2", "Dolroes Jovomil Tarvecina": "p2", "Jovomil Tarvecina Dolores": "p2", "Dani Jovomil": "p3", "Joé Argarrés Kermecina": "p4", "Pepe Argarrés": "p4", "José Argarres Kermecnia": "p4", "José Argarrés Kermecina": "p4"},
    "organization": {"Clin. C. de Quintedra": "o1", "Quintedra, Clínica Comarcal": "o1", "CLÍNICA COMARCAL DE QUINTEDRA": "o1", "C. Naval Lodromil SA": "o2", "Lodrmil, Consorcio Naval S. A.": "o2", "Consorcio Naval Lodromil Sociedad Anónima": "o2", "Tayeres y Montajes Yebusa": "o3", "ConsorciohNaval Lodromil SA": "o2", "Talleres yM ontajes Yebusa": "o3", "Tall. y Mont. Yebusa Sociedad Limitada": "o3"},
}
OTHERS = {"person": ["Dolores Jovomil Restuela", "D. Jovomil", "Ana Pérez", "", "   ", None, "Quintósteo"], "organization": ["Fundación Quintedra", "Consorcio Agrario Lodromil", "S.A."]}


def frame(spark):
    rows = [("t", f"{k}{i}", n, k) for k in MEANT for i, n in enumerate(MEANT[k])] + [("t", f"o{k}{i}", n, k) for k in OTHERS for i, n in enumerate(OTHERS[k])]
    rows += [rows[0], ("t", "long", "palabra " * 5000, "person")]
    return spark.createDataFrame(rows, "tabla string, rec_id string, nombre string, kind string").selectExpr("*", "1 as word", "2 as price")


def test_links(spark):
    nodes = spark.createDataFrame(NODES, "node_key string, name string, entity_type string, community_id int")
    got = {r["nombre"]: r["node_key"] for r in N.variant_mentions(frame(spark), nodes).collect()}
    want = {n: k for kind in MEANT.values() for n, k in kind.items()}
    del want["José Argarrés Kermecina"]  # spelled as in the directory
    assert {n: got.get(n) for n in want} == want
    assert set(got) == set(want)


def test_prior_and_empty(spark):
    nodes = spark.createDataFrame(NODES, "node_key string, name string, entity_type string, community_id int")
    rows = [("t", str(i), "Dolores Jovomil Tarvecina", "person") for i in range(5)] + [("t", "9", "D. Jovomil", "person")]
    df = spark.createDataFrame(rows, "tabla string, rec_id string, nombre string, kind string")
    assert [(r["rec_id"], r["node_key"]) for r in N.variant_mentions(df, nodes).collect()] == [("9", "p2")]
    assert N.variant_mentions(df.limit(0), nodes).count() == 0 and N.variant_mentions(df, nodes.limit(0)).count() == 0


def test_one_typo(spark):
    near = [("jovusa", "jovusa"), ("jvousa", "jovusa"), ("jousa", "jovusa"), ("jovuda", "jovusa"), ("guiyermo", "guillermo")]
    far = [("jouda", "jovusa"), ("jov", "jovusa"), ("ujovas", "jovusa")]
    got = spark.createDataFrame(near + far, "a string, b string").select(N.one_typo("a", "b")).collect()
    assert [r[0] for r in got] == [True] * 5 + [False] * 3


def test_another_directory(spark):
    """Another directory than that of the test data: given names, surnames and organisations of everyday use, every variant linked, every stranger left alone."""
    given = ["Agustín", "Begoña", "Cristina", "Fernando", "Gonzalo", "Joaquín", "Juan José", "María Teresa", "Miguel Ángel", "Nuria", "Pedro", "Ramón", "Sergio", "Tomás"]
    surnames = ["Abascal", "Barrientos", "Castellanos", "Domínguez", "Echevarría", "Fuenmayor", "Gallardo", "Hinojosa", "Izquierdo", "Jaramillo", "Larrañaga", "Montenegro", "Navarrete", "Olivares"]
    people = [(f"p{i}", f"{g} {surnames[i]} {surnames[(3 * i + 5) % 14]}", "person") for i, g in enumerate(given)]
    firms = [("o1", "Panificadora Industrial Montejo S.L.", "organization"), ("o2", "Asociación Vecinal Robledo", "organization"), ("o3", "Suministros Hidráulicos Peralta S.A.", "organization")]
    nick = {"Agustín": "Agus", "Begoña": "Bego", "Cristina": "Cris", "Fernando": "Fer", "Gonzalo": "Gonza", "Joaquín": "Quim", "Juan José": "Juanjo", "María Teresa": "Maite", "Miguel Ángel": "Migue", "Nuria": "Nuri", "Pedro": "Pere", "Ramón": "Moncho", "Sergio": "Sergi", "Tomás": "Tomi"}
    want = {}
    for key, name, _ in people:
        g = next(x for x in given if name.startswith(x + " "))
        a, b = name[len(g) + 1 :].split()
        forms = [f"{a} {b}, {g}", name.upper(), f"{g} {a}", f"{nick[g]} {a}", f"{nick[g]} {a} {b}", f"{g[0]}. {a} {b}", f"{g} {a} {b[0]}.", f"Sr/a. {g} {a}", f"{a}, {g}", f"{g} {a[:3]}{a[4:]} {b}", f"{g} {a} {b[1]}{b[0]}{b[2:]}", f" {g}  {a} {b}"]
        want |= {(f, "person"): key for f in forms}
    want |= {(f, "organization"): k for k, fs in {
        "o1": ["Panif. Ind. Montejo", "PANIFICADORA INDUSTRIAL MONTEJO SL", "Montejo, Panificadora Industrial", "Panificadora Industrial Montejo", "Pdora. Industrial Montejo", "Panificadora Indutrial Montejo S. L."],
        "o2": ["Asoc. Vecinal Robledo", "Ascion. Vecinal Robledo", "A. V. Robledo", "Asociaciones Vecinal Robledo"], "o3": ["Sumin. Hidr. Peralta S.A.", "Suministros Hidraulicos Peralta", "Sum. Hidráulicos Peralta Sociedad Anónima"]}.items() for f in fs}
    strangers = [("Pedro Abascal Ruiz", "person"), ("Nuria Domínguez Domínguez", "person"), ("Lucas Gallardo", "person"), ("Panificadora Robledo", "organization"), ("Asociación Vecinal Peralta", "organization"), ("Transportes Montejo S.L.", "organization")]
    rows = [(n, k, 1) for n, k in [*want, *strangers]]
    got = {(r["nombre"], r["kind"]): r["node_key"] for r in N.link_mentions(spark.createDataFrame(rows, "nombre string, kind string, n long"), spark.createDataFrame(people + firms, "node_key string, name string, entity_type string")).collect()}
    right = sum(got.get(m) == k for m, k in want.items())
    assert right >= 0.99 * len(want), {m: got.get(m) for m in want if got.get(m) != want[m]}
    assert right >= 0.99 * len(got), {m: got[m] for m in got if m not in want}
