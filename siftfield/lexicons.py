"""Compact term lists of crop protection in Spanish; every operator takes its lists as arguments."""

CROPS = [
    ("lenteja", ["lenteja"]), ("trigo", ["trigo"]), ("arroz", ["arroz"]), ("poroto", ["poroto", "frejol", "fréjol"]),
    ("maíz", ["maíz", "maiz"]), ("cebada", ["cebada"]), ("avena", ["avena"]), ("raps", ["raps", "canola"]), ("garbanzo", ["garbanzo"]),
]
LEGUMES = ["garbanzo", "arveja", "haba", "lupino", "leguminosa"]
PRODUCT_TYPES = [
    ("Herbicida", ["herbicida", "malezas"]), ("Fungicida", ["fungicida", "enfermedades"]), ("Insecticida", ["insecticida", "plagas"]), ("Desecante", ["desecante", "desecación"]),
]
INGREDIENTS = [("glifosato", ["glifosato"]), ("metribuzina", ["metribuzin"]), ("mancozeb", ["mancozeb"]), ("clopiralid", ["clopiralid"]), ("linuron", ["linur"])]
WEEDS = [("ballica", ["ballica", "lolium"]), ("rábano", ["rábano", "rabano", "raphanus"]), ("yuyo", ["yuyo", "brassica"]), ("avenilla", ["avenilla", "avena fatua"]), ("hualcacho", ["hualcacho", "echinochloa"])]
WEED_GATE = ["maleza", "controlar", "control de", "herbicida"]
DOSE_PATTERNS = [r"(?i)\d+(?:[.,]\d+)?\s*(?:-|a)\s*\d+(?:[.,]\d+)?\s*(?:kg|l|lt|g|cc|ml)\s*/\s*h[aá]", r"(?i)\d+(?:[.,]\d+)?\s*(?:kg|l|lt|g|cc|ml)\s*/\s*h[aá]"]
UNITS = ["kg/ha", "L/ha", "g/ha", "cc/ha", "ml/ha"]
HEADINGS = ["composición", "modo de acción", "precauciones", "advertencias", "compatibilidad", "almacenamiento"]
FORMULATIONS = ["WP", "EC", "SC", "SL", "WG", "SE", "EW"]
STAGES = [("preemergencia", ["pre-emergencia", "preemergencia", "pre emergencia"]), ("postemergencia", ["post-emergencia", "postemergencia", "post emergencia"]), ("presiembra", ["presiembra", "antes de la siembra"])]
#: Terms of a text that is about applying products. Fixed values.
RELEVANT_TERMS = [
    "aplicacion", "dosis", "tratamiento", "cultivo", "plaga", "fungicida", "herbicida", "insecticida", "temporada",
    "hectarea", "maximo", "minimo", "dias", "frecuencia", "carencia", "intervalo", "litros", "gramos",
]
