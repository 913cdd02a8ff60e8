r"""Pattern inventory, scope patterns and lexicons: data that callers may replace.

Java regex dialect: used with the flags of FLAGS, under which case, \b, \s and \w follow Unicode and ^ $ . know only \n.
"""

FLAGS = "(?imUd)"
SPAN_FLAGS = "(?iUd)"
DOTALL_FLAGS = "(?isUd)"
CATEGORY_SCORE = {"strong": 3, "medium": 2, "high_noise": 1}

# Label, category, regex.
INVENTORY = [
    ("on entend par", "strong", r"\bon entend par\b"),
    ("on désigne par", "strong", r"\bon désigne par\b"),
    ("au sens du présent", "strong", r"\bau sens du présent\b"),
    ("au sens de la présente", "strong", r"\bau sens de la présente\b"),
    ("pour l'application du présent", "strong", r"\bpour l['’]application du présent\b"),
    ("pour l'application de la présente", "strong", r"\bpour l['’]application de la présente\b"),
    ("aux fins du présent", "strong", r"\baux fins du présent\b"),
    ("aux fins de la présente", "strong", r"\baux fins de la présente\b"),
    ("au sens du présent étendu", "strong", r"\bau sens (?:du présent (?:article|chapitre|titre|livre|code|décret|règlement|arrêté)|de la présente (?:section|loi|ordonnance|directive|partie))\b"),
    ("guillemets_définition", "strong", r"\bon entend par\s+[«\"][^»\"]{1,100}[»\"]"),
    ("défini comme", "strong", r"\bdéfini(?:e|s|es)? comme\b"),
    ("est défini", "strong", r"\best défini(?:e)?\b"),
    ("sont définis", "strong", r"\bsont défini(?:e)?s\b"),
    ("est entendu comme", "strong", r"\best entendu(?:e|s|es)? comme\b"),
    ("se définit comme", "strong", r"\bse défini(?:t|ssent) comme\b"),
    ("est qualifié de", "strong", r"\best qualifié(?:e)? de\b"),
    ("sont qualifiés de", "strong", r"\bsont qualifié(?:e)?s de\b"),
    ("est considéré comme", "strong", r"\best considéré(?:e)? comme\b"),
    ("sont considérés comme", "strong", r"\bsont considéré(?:e)?s comme\b"),
    ("est regardé comme", "strong", r"\best regardé(?:e|s|es)? comme\b"),
    ("est réputé", "medium", r"\best réputé(?:e)?\b"),
    ("sont réputés", "medium", r"\bsont réputé(?:e)?s\b"),
    ("s'entend de", "strong", r"\bs['’]entend(?:ent)?\s+(?:de|comme|par)\b"),
    ("au sens de", "medium", r"\bau sens de\s+(?:l['’]article|du règlement|de la directive|du code|de l['’]ordonnance)\b"),
    ("par terme on entend", "strong", r"\bpar\s+[«\"][^»\"]{1,100}[»\"],?\s+on entend\b"),
    ("ci-après dénommé", "medium", r"\bci[- ]après\s+(?:dénommé|désigné|appelé)(?:e|s|es)?\b"),
    ("au sens strict", "medium", r"\bau sens\s+(?:strict|large|technique|juridique)\b"),
    ("terme_colon_definition", "strong", r"(?:^|\n|;\s*)\s*(?:\d+°\s*)?[A-ZÉÈÀÂÊÎÔÛÇ][A-Za-zÀ-ÖØ-öø-ÿ0-9'’\-\s]{2,100}\s*:\s+(?:un|une|des|du|de la|de l'|tout|toute|tous|toutes|la|le|les|l')\b"),
    ("désigne", "high_noise", r"\bdésigne(?:nt)?\b"),
    ("constitue", "high_noise", r"\bconstitue(?:nt)?\b"),
    ("vise", "high_noise", r"\b(?:le présent article|la présente loi|le présent texte|la présente section)\s+vise(?:nt)?\b"),
]

# Labels that sampling prefers.
PRIORITY = ["on entend par", "s'entend de", "terme_colon_definition", "guillemets_définition", "défini comme", "sont définis", "est défini", "au sens du présent", "au sens du présent étendu", "au sens de la présente", "pour l'application du présent", "pour l'application de la présente", "sont considérés comme", "est considéré comme"]

# Scope regexes, the first that matches wins.
SCOPES = [(rf"\b(?:pour l['’]application|au sens|aux fins) {of}\b", label) for of, label in (("du présent article", "article"), ("de la présente section", "section"), ("du présent chapitre", "chapitre"), ("du présent titre", "titre"), ("du présent livre", "livre"), ("du présent code", "code"))]

# Terms that are no terms.
BAD_TERMS = ["qui", "que", "dont", "où", "ou", "précité", "précitée", "précités", "précitées", "susvisé", "susvisée", "susvisés", "susvisées"]
BAD_TERM_STARTS = ["au titre", "aux titres", "au chapitre", "aux chapitres", "au livre", "aux livres", "à la section", "aux sections", "aux articles", "les articles", "l'article", "du ", "de l'article", "territoires composition", "constituent des", "constituent les", "sont applicables", "sont soumis", "sont soumises"]
BAD_TERM_PARTS = ["communes de", "articles l.", "article l.", "dispositions abrogées"]
BAD_TERM_REGEXES = [r"\barticles?\s+\d+\b", r"\b\d{1,2}\s+(janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre)\s+\d{4}\b"]
BAD_COLON_TERM_PARTS = ["sont soumises aux dispositions suivantes", "sont soumis aux dispositions suivantes", "est soumis aux dispositions suivantes", "sont applicables", "s'appliquent", "ne s'appliquent pas", "doivent comporter", "comprennent notamment", "comprend notamment", "sont fixées", "sont fixés", "sont déterminées", "sont déterminés"]
BAD_COLON_BODY_PARTS = ["sont soumises aux dispositions suivantes :", "sont soumis aux dispositions suivantes :", "doivent comporter :", "comprennent :", "comprend :", "sont fixées par :", "sont fixés par :"]
BAD_COLON_STARTS = ["les dispositions", "les conditions", "les modalités", "les règles", "les mesures", "le ministre", "la décision", "l'autorité"]

# Where definitions of the rule extractors stop.
STOPS = [r"\s+Les\s+modalités\s+", r"\s+Un\s+décret\s+", r"\s+Un\s+arrêté\s+", r"\s+Ces\s+dispositions\s+", r"\s+Pour\s+l'application\s+du\s+présent\s+alinéa\s*,"]

# Span regexes of the draft extractors (pattern label, flags, regex, groups by name).
_HEAD = r"(?:un|une|des|du|de la|de l'|d'|tout|toute|tous|toutes|la|le|les|l')\b"
_NAME = r"[A-ZÉÈÀÂÊÎÔÛÇ][A-Za-zÀ-ÖØ-öø-ÿ0-9'’\-\s]{2,80}"
DRAFTS = [
    ("terme_colon_definition", SPAN_FLAGS, rf"(\d+°\s*)?({_NAME})\s*:\s+({_HEAD}[^;\n]{{10,500}})", {"item": 1, "term": 2, "definition": 3}),
    ("on entend par", DOTALL_FLAGS, rf"(?:(?:pour l['’]application|au sens|aux fins)[^,.:\n]{{0,140}}[,:\s]+)?on entend par\s+[«\"]?([^,»\":\n]{{2,100}})[»\"]?\s*(?:,|:)?\s+({_HEAD}.{{10,900}})", {"term": 1, "definition": 2}),
    ("s'entend de", SPAN_FLAGS, r"\b(?:le|la|les|l['’])\s+([A-Za-zÀ-ÖØ-öø-ÿ'’\-\s]{2,80}?)\s*,\s*qui\s+s['’]entend(?:ent)?\s+de\s+([^.;,\n]{5,300})", {"term": 1, "definition": 2}),
    ("s'entend de", SPAN_FLAGS, r"\b(?:le terme|les termes|le mot|les mots|l['’]expression)\s+[«\"]?([^»\".,:\n]{2,100})[»\"]?\s+s['’]entend(?:ent)?\s+(?:de|comme|par)\s+([^.;\n]{5,400})", {"term": 1, "definition": 2}),
    ("s'entend de", SPAN_FLAGS, r"(?<!\.)\b([A-ZÉÈÀÂÊÎÔÛÇ][A-Za-zÀ-ÖØ-öø-ÿ'’\-\s]{2,80})\s+s['’]entend(?:ent)?\s+(?:de|comme|par)\s+([^.;\n]{5,400})", {"term": 1, "definition": 2}),
    ("défini comme", SPAN_FLAGS, rf"({_NAME})\s*,?\s+défini(?:e|s|es)?\s+comme\s+([^.;\n]{{10,500}})", {"term": 1, "definition": 2}),
    *((label, SPAN_FLAGS, rf"([^.;\n]{{2,120}}?)\s+{verb}\s+([^.;,\n]{{2,80}})\s+(?:lorsqu[’']?{who}|lorsque|si)\s+([^.;\n]{{5,400}})", {"subject": 1, "term": 2, "definition": 3}) for label, verb, who in (("est qualifié de", "est qualifié(?:e)? de", "il"), ("sont qualifiés de", "sont qualifié(?:e)?s de", "ils"), ("est considéré comme", "est considéré(?:e)? comme", "il"), ("sont considérés comme", "sont considéré(?:e)?s comme", "ils"))),
]
#: A neutral colon rule for invented prose: up to four words, a colon, and what follows up to the end of the clause.
NEUTRAL_DRAFTS = [("neutral colon", "", r"([A-Za-z0-9]+(?: [A-Za-z0-9]+){0,3}) ?: ([^;:.\n]{10,500})", {"term": 1, "definition": 2})]
#: What any text that one of these span regexes matches holds, so that others are searched for this alone.
NEEDED = {regex: word for label, _, regex, _ in DRAFTS + NEUTRAL_DRAFTS for word in [{"on entend par": "on entend par", "s'entend de": "s['’]entend", "défini comme": "défini", "est qualifié de": "qualifié", "sont qualifiés de": "qualifié", "est considéré comme": "considéré", "sont considérés comme": "considéré"}.get(label, ":")]}
MOST_TERM_WORDS = {"terme_colon_definition": 12, "on entend par": 12, "s'entend de": 8}

# The rule extractors, the first that gives a term and a definition wins (rule, regex, term groups, definition group).
RULES = [
    ("colon_definition", r"^\s*(?:(?:\d+°(?:\s+bis|\s+ter)?|[a-z]\)|[IVXLC]+\.)\s*)?([^:]{2,220}?)\s*:\s*(.+)$", (1,), 2),
    ("on_entend_par", r"(?:on\s+entend\s+par|sont\s+entendus\s+par)\s+(?:[\"“]([^\"”]{1,220})[\"”]|([^,:;\n]{1,220}?))\s*(?:,|:)?\s+(.+)$", (1, 2), 3),
    ("sentend_de", r"(.{1,220}?)\s+s['’]\s*entend(?:ent)?\s+de\s+(.+)$", (1,), 2),
    ("defini_comme", r"(.{1,220}?)\s+(?:est\s+|sont\s+)?(?:défini|définie|définis|définies)\s+comme\s+(.+)$", (1,), 2),
    ("qualification", r".{1,180}?\s+(?:est|sont)\s+considéré(?:e|s|es)?\s+comme\s+(.{1,160}?)\s+(?:si|lorsque|quand|dès lors que)\s+(.+)$", (1,), 2),
]
SCOPE_PREFIX = r"^(?:pour\s+l'application\s+[^,]+,\s*)"

# Declared schema of the validator.
REQUIRED = ["definition_id", "source_code", "article_number", "item_number", "defined_subject", "term", "definition", "scope_text", "scope_label", "inferred_scope", "pattern", "definition_type", "raw_body"]
SCOPE_LABELS = ["article", "section", "chapitre", "titre", "livre", "code", "unspecified"]
DEFINITION_TYPES = ["explicit", "explicit_subitem", "explicit_internal", "explicit_enumerative", "explicit_qualification"]

# Columns of a merged record in order; labels of accepted reviews; the usual name of a code with three names; leading articles.
FINAL_FIELDS = ["definition_id", "source_code", "article_number", "article_id", "etat", "date_debut", "date_fin", "item_number", "term", "defined_subject", "definition", "scope_text", "scope_label", "inferred_scope", "pattern", "definition_type", "raw_body", "source_file", "annotation_source", "manual_label", "candidate_definition_id", "correction_notes", "previous_definition_id"]
ACCEPTED_LABELS = ["valid_definition", "partial"]
RURAL = "code rural et de la pêche maritime"
LEADING_ARTICLES = ["L'", "l'", "Le ", "La ", "Les ", "Un ", "Une ", "Des "]

# Hints of the error review.
HINTS = {
    "kept_invalid": "Le modèle a conservé un candidat annoté invalid.",
    "colon": "Vérifier si le deux-points introduit une liste, un intitulé, une condition ou un segment non définitionnel.",
    "short": "Définition très courte : risque de fragment incomplet.",
    "absent": "Le terme candidat n'apparaît pas littéralement dans le contexte.",
    "rejected_accepted": "Le modèle a rejeté un candidat pourtant accepté.",
    "partial": "Le gold est partial : cas probablement ambigu pour le modèle.",
    "canonical": "Pattern canonique accepté mais possiblement avec frontières atypiques.",
    "long": "Définition longue : le modèle peut confondre définition et développement normatif.",
}

# Accented letters and what they become.
ACCENTED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
