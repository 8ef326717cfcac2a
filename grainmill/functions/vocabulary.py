"""Fixed values. Results depend on these exact words, so they are stated as plain text."""

# Column-name words that give a column its role.
ID_WORDS = ["id", "sku", "reference", "ref", "numero", "code_commande", "order_id", "invoice_id"]
# An identifier's name is one of these words, or begins or ends with "id".
ID_SHAPE = "|".join([*ID_WORDS, "id_.*", ".*_id"])

# Name fragments per outcome; the first rule with a fragment of each of its groups holds.
LABEL_RULES = [
    ("city", [["ville", "city", "localisation"]]),
    ("channel", [["canal", "channel"]]),
    ("status", [["statut", "status", "etat"]]),
    ("customer_type", [["client"], ["type", "profil", "segment"]]),
    ("category", [["categorie", "category"]]),
]
MODE_FILL_RULES = [
    ("forbidden", [["id", "code", "identifiant", "numero", "nom", "name", "produit", "vendeur"]]),
    *[("allowed", groups) for _, groups in LABEL_RULES],
    ("allowed", [["mode", "paiement", "payment", "pays", "region", "segment"]]),
]
AMOUNT_WORDS = [
    "montant", "amount", "total", "prix", "price", "revenue", "chiffre", "ventes", "sales",
    "cout", "cost", "marge", "margin", "remise", "discount", "frais", "tva", "ttc", "ht",
]
QUANTITY_WORDS = ["quantite", "quantity", "qte", "qty"]
NON_NEGATIVE_WORDS = QUANTITY_WORDS + ["prix", "price", "frais", "cout", "cost", "delai"]
RATING_WORDS = ["note", "rating", "satisfaction", "stars", "etoiles"]
DATE_WORDS = ["date", "jour", "mois", "annee", "time", "created", "updated", "timestamp"]
DATE_HINT_WORDS = ["date", "jour", "mois", "annee", "heure", "time", "created", "updated", "timestamp"]

# Preferred columns, best first.
DIMENSION_PRIORITY = [
    "produit", "product", "categorie_produit", "categorie", "category", "ville", "city",
    "canal_vente", "canal", "channel", "fournisseur", "supplier", "client",
]
AMOUNT_PRIORITY = [
    "chiffre_affaires_net_mad", "chiffre_affaires_net", "net_revenue", "montant", "amount",
    "total_ttc", "total", "ventes", "sales", "revenue", "total_brut_mad",
]
BRIEF_AMOUNT_PRIORITY = [
    "chiffre_affaires_net_mad", "chiffre_affaires_net", "net_revenue",
    "montant", "total_ttc", "total", "ventes", "sales", "revenue",
]
BRIEF_GROUP_PRIORITY = ["produit", "product", "categorie", "category", "ville", "city"]
BRIEF_COST_PRIORITY = ["cout", "cout_total", "cost", "cost_total", "charges"]
CAPTURE_AMOUNT_PRIORITY = [
    "montant", "total_ttc", "total", "ventes", "sales", "revenue", "chiffre_affaires_net", "net_revenue",
]
CAPTURE_PRODUCT_PRIORITY = ["produit", "product", "article", "libelle", "designation", "categorie", "category"]
CAPTURE_QUANTITY_PRIORITY = ["quantite", "quantity", "qte"]
CAPTURE_DATE_PRIORITY = ["date", "date_vente", "date_facture"]

# Names a sales table may give to its ten measures.
SALES_ROLES = {
    "quantity": ["quantite", "quantity", "qte"],
    "unit_price": ["prix_unitaire_mad", "prix_unitaire", "unit_price"],
    "discount": ["remise_mad", "remise", "discount"],
    "delivery_fee": ["frais_livraison_factures_mad", "frais_livraison", "delivery_fee"],
    "delivery_cost": ["cout_livraison_mad", "cout_livraison", "delivery_cost"],
    "gross": ["total_brut_mad", "total_brut", "gross_total"],
    "net": ["chiffre_affaires_net_mad", "chiffre_affaires_net", "net_revenue"],
    "margin": ["marge_brute_mad", "marge_brute", "gross_margin"],
    "status": ["statut_commande", "statut", "status"],
    "score": ["note_satisfaction", "satisfaction", "score", "note"],
}

# Known labels by column role, keyed by normalised spelling.
KNOWN_LABELS = {
    "city": {"casa": "Casablanca", "casblanca": "Casablanca", "marrakesh": "Marrakech", "fes": "Fès"},
    "channel": {
        "whatsapp": "WhatsApp", "wathsapp": "WhatsApp", "en magasin": "Boutique", "magasin": "Boutique",
    },
    "status": {"livree": "Livrée", "livre": "Livrée", "annulee": "Annulée"},
    "customer_type": {"fidele": "Fidèle"},
    "category": {"epicerie": "Épicerie"},
}

# French month names (table dates) and French/English names (invoice dates).
FRENCH_MONTHS = {
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6,
    "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
}
ENGLISH_MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}

# Words that mean "free of charge".
FREE_WORDS = ["gratuit", "offert", "free"]

# Label shown for a missing category and for the grouped remainder of a chart.
MISSING_LABEL = "Non renseigné"
OTHER_LABEL = "Autres"
MANUAL_SOURCE_LABEL = "Saisie manuelle"
CONFIRMED_LABEL = "Confirmé par vous"
TO_CHECK_LABEL = "À vérifier"
TO_COMPLETE_LABEL = "À compléter"

# Business concepts and the phrases that name them (French, English, Arabic).
BUSINESS_CONCEPTS = {
    "revenue": [
        "chiffre d affaires", "chiffre affaires", "ca", "ventes", "vente", "revenu", "revenus",
        "recette", "recettes", "sales", "revenue", "المبيعات", "الإيرادات", "رقم المعاملات",
    ],
    "amount": ["montant", "valeur", "prix", "amount", "value", "price", "المبلغ", "القيمة", "السعر"],
    "cost": [
        "cout", "couts", "depense", "depenses", "charge", "charges", "cost", "costs",
        "التكلفة", "التكاليف", "المصاريف",
    ],
    "profit": [
        "benefice", "benefices", "marge", "profit", "profits", "margin", "الربح", "الأرباح", "الهامش",
    ],
    "quantity": [
        "quantite", "quantites", "qte", "volume", "unites", "quantity", "units",
        "الكمية", "الكميات", "الوحدات",
    ],
    "date": [
        "date", "jour", "semaine", "mois", "trimestre", "annee", "time", "day", "week", "month", "year",
        "التاريخ", "اليوم", "الأسبوع", "الشهر", "السنة",
    ],
    "region": [
        "region", "zone", "territoire", "province", "area", "territory", "المنطقة", "الجهة", "الإقليم",
    ],
    "city": ["ville", "commune", "city", "town", "المدينة", "البلدية"],
    "customer": [
        "client", "clients", "customer", "customers", "acheteur", "acheteurs",
        "العميل", "العملاء", "الزبون", "الزبناء",
    ],
    "product": [
        "produit", "produits", "article", "articles", "service", "services", "product", "products",
        "المنتج", "المنتوج", "المنتجات",
    ],
    "channel": ["canal", "canaux", "channel", "channels", "reseau", "réseau", "القناة", "القنوات"],
}

# Phrases that ask for a calculation, a chart type, or a grouping; first match wins.
AGGREGATION_PHRASES = {
    "mean": ["moyenne", "moyen", "average", "mean", "متوسط", "المتوسط"],
    "median": ["mediane", "median", "médiane", "الوسيط"],
    "sum": ["somme", "total", "cumule", "cumul", "sum", "اجمالي", "إجمالي", "المجموع"],
    "count": ["nombre", "combien", "compte", "count", "عدد", "كم"],
}
CHART_PHRASES = {
    "line": ["courbe", "evolution", "évolution", "tendance", "chronologique", "line", "تطور", "منحنى"],
    "doughnut": ["camembert", "anneau", "proportion", "parts", "doughnut", "دائري", "نسب"],
    "bar": ["barre", "barres", "histogramme", "colonnes", "bar chart", "أعمدة"],
}
GROUPING_MARKERS = ["par", "selon", "en fonction de", "by", "حسب", "لكل"]

# Entity words recognised in a "how many" question.
COUNT_MARKERS = ["combien", "nombre de", "how many"]
ENTITY_WORDS = {
    "joueurs": ["joueur", "joueurs", "player", "players", "footballeur", "footballeurs"],
    "clients": ["client", "clients", "customer", "customers"],
    "équipes": ["equipe", "equipes", "team", "teams", "club", "clubs"],
    "produits": ["produit", "produits", "product", "products", "article", "articles"],
}

# Column-name pattern whose values must not leave in a summary.
SENSITIVE_NAME = (
    r"(^|[^a-z])(nom|name|email|mail|telephone|phone|tel|adresse|address|cin|"
    r"passport|client|customer|contact|identifiant|identifier|id)([^a-z]|$)"
)

# Letters used by the two transliterations.
ARABIC_TO_LATIN = {
    "ا": "a", "أ": "a", "إ": "i", "آ": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h",
    "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d",
    "ط": "t", "ظ": "z", "ع": "3", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m",
    "ن": "n", "ه": "h", "ة": "a", "و": "w", "ؤ": "w", "ي": "y", "ى": "a", "ئ": "y", "ء": "'",
}
LATIN_PAIRS_TO_ARABIC = {
    "kh": "خ", "gh": "غ", "ch": "ش", "sh": "ش", "th": "ث", "dh": "ذ",
    "ph": "ف", "ou": "و", "oo": "و", "ee": "ي",
}
LATIN_TO_ARABIC = {
    "a": "ا", "b": "ب", "c": "ك", "d": "د", "e": "ي", "f": "ف", "g": "گ", "h": "ه", "i": "ي",
    "j": "ج", "k": "ك", "l": "ل", "m": "م", "n": "ن", "o": "و", "p": "ب", "q": "ق", "r": "ر",
    "s": "س", "t": "ت", "u": "و", "v": "ڤ", "w": "و", "x": "كس", "y": "ي", "z": "ز",
}
