"""Word lists of the safety rules.

Fixed values: results depend on them, so they are kept as published, in their order. They are data; every rule takes other
lists as parameters.
"""

from __future__ import annotations

# Diagnoses, without accents.
CONDITIONS = [
    "psoriasis", "eccema", "eczema", "dermatitis", "dermatitis de contacto",
    "dermatitis seborreica", "dermatitis atopica", "urticaria", "liquen plano",
    "tina", "tinea", "foliculitis", "sifilis", "dishidrosis", "linfangioma",
    "nevus", "nevo", "angioma", "verruga", "acne", "melanoma", "carcinoma",
    "vitiligo", "rosacea", "impetigo", "herpes", "escabiosis", "sarna",
    "alopecia", "paroniquia", "celulitis", "molusco", "queratosis",
    "pitiriasis", "intertrigo", "candidiasis", "eritema multiforme",
    "granuloma", "granuloma anular", "onicomicosis", "necrobiosis lipoidea",
    "sindrome de sweet", "penfigoide", "lupus", "escarlatina",
    "erupcion por medicamentos", "erupcion medicamentosa", "farmacodermia",
    "erupcion fija", "exantema", "picadura de insecto",
]

# Sensitive recommendations by category.
RISK_TERMS = {
    "procedimiento_invasivo": ["biopsia", "cirugia", "extirpacion", "infiltracion", "extraccion"],
    "farmaco_sistemico": ["antibiotico", "antibioticos", "corticoide", "corticoides", "corticosteroide", "isotretinoina", "metotrexato", "inmunosupresor", "prednisona"],
    "tratamiento_hormonal": ["hormona", "hormonal", "estrogeno", "testosterona"],
}
HIGH_RISK = ("procedimiento_invasivo", "farmaco_sistemico")

# Tests and treatments a draft may recommend.
RECOMMENDATIONS = [
    "biopsia", "cultivo", "serologia", "dermatoscopia",
    "prueba de hongos", "prueba de patologia", "prueba de alergenos",
    "prueba de sangre", "pruebas de sangre", "analisis de sangre", "examen de sangre",
    "prueba de funcion hepatica",
    "antihistaminico", "antihistaminicos", "antifungico", "antifungicos",
    "antimicotico", "antibiotico", "antibioticos",
    "crioterapia", "laser", "fototerapia",
    "derivar", "derivacion", "interconsulta",
]

# Warning signs in a query; a sign is met if all terms of one of its groups are.
RED_FLAGS = [
    ("sospecha_melanoma", [["melanoma"]]),
    ("mencion_cancer", [["cancer"], ["carcinoma"], ["metastasis"], ["maligno"], ["maligna"]]),
    ("lesion_pigmentada_cambiante", [
        ["lunar", "cambio"], ["lunar", "cambia"], ["lunar", "crece"], ["lunar", "crecio"],
        ["lunar", "sangra"], ["lunar", "asimetric"], ["lunar", "color"],
        ["mancha", "sangra"], ["mancha", "crece"], ["mancha", "negro"], ["mancha", "negra"],
        ["nevo", "cambio"], ["nevo", "crece"], ["nevo", "sangra"],
        ["lesion pigmentada", "cambio"], ["lesion pigmentada", "crece"],
        ["pigmentada", "asimetric"],
    ]),
    ("lesion_no_cicatriza", [["no cicatriza"], ["no cierra"], ["no cura"], ["no termina de cerrar"], ["ulcera", "meses"], ["herida", "no cierra"]]),
    ("lesion_acral", [["acral"], ["planta del pie"], ["subungueal"], ["region palmoplantar"]]),
    ("crecimiento_rapido", [["crecio", "semanas"], ["crecio", "dias"], ["crece rapido"], ["rapido crecimiento"], ["crecimiento rapido"], ["creciendo rapido"]]),
    ("sangrado", [["sangra"], ["sangrado"], ["sangrante"]]),
    ("urgencia_sistemica", [["fiebre", "ampollas"], ["fiebre", "despega"], ["piel se despega"], ["dificultad", "respirar"], ["se despega la piel"], ["necrosis"]]),
]

# Phrases that reassure.
REASSURING = [
    "se puede descartar", "descartar la posibilidad", "se descarta",
    "no es preocupante", "no reviste gravedad", "no es grave", "sin gravedad",
    "es benigno", "es benigna", "no hay de que preocuparse", "quedese tranquilo",
    "no requiere tratamiento", "no amerita",
]
