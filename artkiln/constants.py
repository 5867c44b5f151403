"""Word lists, catalogues, patterns and thresholds.

Everything in this module is a fixed value. The numbers and words must stay
exactly as they are for results to be right, so they are written out plainly
and in their natural order.
"""

from __future__ import annotations

# --------------------------------------------------------------- matrix columns
# Canonical matrix column -> accepted header slugs.
HEADER_ALIASES: dict[str, tuple[str, ...]] = {
    "producto": ("producto", "product", "nombre_producto", "nombre", "sku"),
    "imagen": ("imagen", "image", "foto", "archivo", "file", "product_image"),
    "titular": ("titular", "headline", "copy", "titulo"),
    "subtitulo": ("subtitulo", "subtitle", "subheadline", "bajada"),
    "precio_anterior": ("precio_anterior", "old_price", "previous_price", "precio_antes", "pvp"),
    "precio_actual": ("precio_actual", "precio", "price", "current_price", "precio_oferta"),
    "cuota": ("cuota", "cuotas", "installment", "installments"),
    "descuento": ("descuento", "discount", "ahorro"),
    "cta": ("cta", "llamado", "llamado_a_la_accion", "call_to_action"),
    "legal": ("legal", "legales", "terminos", "terms", "restricciones"),
    "vigencia": ("vigencia", "validity", "fecha", "fechas"),
    "formatos": ("formatos", "formato", "formats", "format", "tamanos", "medidas"),
    "cantidad_propuestas": (
        "cantidad_propuestas", "propuestas", "cantidad", "variantes", "variants", "proposals", "count",
    ),
    "plantilla": ("plantilla", "template"),
    "modo": ("modo", "mode", "agrupacion", "tipo_de_arte", "arte_por_producto"),
    "notas": ("notas", "notes", "instrucciones", "instruction"),
}
ALIAS_TO_COLUMN = {alias: name for name, aliases in HEADER_ALIASES.items() for alias in aliases}

# Cells that forbid a field instead of leaving it open.
SUPPRESS_TOKENS = ("no_poner", "no_mostrar", "no_usar", "omitir", "suprimir", "sin_contenido")
# Cells that ask for one art per product.
INDIVIDUAL_TOKENS = (
    "individual", "individuales", "uno_por_producto", "un_arte_por_producto",
    "por_producto", "separado", "separados", "si",
)
# Optional text columns in contract order.
OPTIONAL_TEXT = (
    "imagen", "titular", "subtitulo", "precio_anterior", "precio_actual", "cuota",
    "descuento", "cta", "legal", "vigencia", "plantilla", "notas",
)
# Copy fields a template has to be able to hold.
CONTENT_FIELDS = (
    "titular", "subtitulo", "precio_anterior", "precio_actual", "cuota",
    "descuento", "cta", "legal", "vigencia",
)
COMMERCIAL_FIELDS = ("precio_anterior", "precio_actual", "cuota", "descuento")
PER_PRODUCT_FIELDS = ("precio_actual", "precio_anterior", "cuota", "descuento")
MAX_PROPOSALS = 6
SEPARATORS = (",", "\t", ";")

# Slot ids whose copy may be generated, and their matrix column.
COPY_SLOT_ALIASES = {
    "headline": "titular", "title": "titular", "subheadline": "subtitulo",
    "subtitle": "subtitulo", "call_to_action": "cta",
}
COPY_FIELDS = ("titular", "subtitulo", "cta")
COPY_LENGTHS = {"titular": 220, "subtitulo": 300, "cta": 80}

# Shown names of the matrix fields.
FIELD_LABELS = {
    "producto": "producto", "titular": "titular", "subtitulo": "subtítulo",
    "precio_anterior": "precio anterior", "precio": "precio", "cuota": "cuota",
    "descuento": "descuento", "cta": "CTA", "legal": "legal", "vigencia": "vigencia",
}

# ------------------------------------------------------------------- formats
# Id, platform, family, placement, width, height, ratio,
# safe area (left, top, right, bottom), recommended.
_S = (0.035, 0.035, 0.035, 0.035)
_T = (0.10, 0.10, 0.10, 0.10)
FORMAT_PRESETS = (
    ("meta_instagram_feed_3_4", "Meta", "Feed", "Instagram Feed orgánico", 1080, 1440, "3:4", _S, True),
    ("meta_feed_4_5", "Meta", "Feed", "Feed vertical universal", 1080, 1350, "4:5", _S, True),
    ("meta_feed_square", "Meta", "Feed", "Feed cuadrado", 1080, 1080, "1:1", _S, False),
    ("meta_feed_landscape", "Meta", "Feed", "Feed horizontal", 1080, 566, "1.91:1", _S, False),
    ("meta_stories", "Meta", "Pantalla completa", "Stories", 1080, 1920, "9:16", (0.04, 0.14, 0.04, 0.20), True),
    ("meta_reels", "Meta", "Pantalla completa", "Reels", 1080, 1920, "9:16", (0.06, 0.14, 0.06, 0.35), True),
    ("meta_carousel_4_5", "Meta", "Carrusel", "Carrusel vertical", 1080, 1350, "4:5", _S, True),
    ("meta_carousel_square", "Meta", "Carrusel", "Carrusel cuadrado", 1080, 1080, "1:1", _S, False),
    ("google_business_square", "Google Ads", "Orgánico", "Google Business Profile", 720, 720, "1:1", _S, True),
    ("google_search_square", "Google Ads", "Búsqueda", "Recurso de imagen cuadrado", 1200, 1200, "1:1", _T, True),
    ("google_search_landscape", "Google Ads", "Búsqueda", "Recurso de imagen horizontal", 1200, 628, "1.91:1", _T, True),
    ("google_pmax_landscape", "Google Ads", "Performance Max", "Performance Max horizontal", 1200, 628, "1.91:1", _S, True),
    ("google_pmax_square", "Google Ads", "Performance Max", "Performance Max cuadrado", 1200, 1200, "1:1", _S, True),
    ("google_pmax_vertical", "Google Ads", "Performance Max", "Performance Max vertical", 960, 1200, "4:5", _S, True),
    ("google_demand_gen_square", "Google Ads", "Demand Gen", "Demand Gen cuadrado", 1200, 1200, "1:1", _S, True),
    ("google_demand_gen_landscape", "Google Ads", "Demand Gen", "Demand Gen horizontal", 1200, 628, "1.91:1", _S, True),
    ("google_demand_gen_vertical", "Google Ads", "Demand Gen", "Demand Gen vertical", 960, 1200, "4:5", _S, True),
    ("google_demand_gen_fullscreen", "Google Ads", "Demand Gen", "Demand Gen / Shorts vertical", 1080, 1920, "9:16", _S, True),
    ("google_display_300x250", "Google Ads", "Display", "Banner mediano", 300, 250, "6:5", _S, False),
    ("google_display_336x280", "Google Ads", "Display", "Rectángulo grande", 336, 280, "6:5", _S, False),
    ("google_display_728x90", "Google Ads", "Display", "Leaderboard", 728, 90, "8.09:1", _S, False),
    ("google_display_970x90", "Google Ads", "Display", "Leaderboard grande", 970, 90, "10.78:1", _S, False),
    ("google_display_160x600", "Google Ads", "Display", "Skyscraper ancho", 160, 600, "4:15", _S, False),
    ("google_display_300x600", "Google Ads", "Display", "Media página", 300, 600, "1:2", _S, False),
    ("google_display_320x50", "Google Ads", "Display", "Banner móvil", 320, 50, "6.4:1", _S, False),
    ("youtube_video_landscape", "YouTube", "Video", "Video horizontal", 1920, 1080, "16:9", _S, True),
    ("youtube_video_vertical", "YouTube", "Video", "Video vertical / Shorts", 1080, 1920, "9:16", _S, True),
    ("youtube_video_square", "YouTube", "Video", "Video cuadrado", 1080, 1080, "1:1", _S, True),
    ("youtube_thumbnail", "YouTube", "Imagen", "Miniatura", 1280, 720, "16:9", _S, True),
    ("youtube_companion", "YouTube", "Imagen", "Banner complementario", 300, 60, "5:1", _S, False),
)
# Older size names, in order.
LEGACY_SIZES = (
    ("1080x1080", 1080, 1080), ("1080x1350", 1080, 1350), ("1080x1920", 1080, 1920),
    ("1920x1080", 1920, 1080), ("900x660", 900, 660), ("900x1350", 900, 1350), ("1200x400", 1200, 400),
)
DEFAULT_SAFE = _S
# Spoken format names -> preset id.
FORMAT_ALIASES = {
    "feed": "meta_feed_4_5", "feed_vertical": "meta_feed_4_5", "instagram_feed": "meta_instagram_feed_3_4",
    "post": "meta_feed_4_5", "post_vertical": "meta_feed_4_5", "cuadrado": "meta_feed_square",
    "square": "meta_feed_square", "story": "meta_stories", "stories": "meta_stories",
    "historia": "meta_stories", "historias": "meta_stories", "reel": "meta_reels", "reels": "meta_reels",
    "horizontal": "meta_feed_landscape", "landscape": "meta_feed_landscape",
}
DEFAULT_FORMAT = "meta_feed_4_5"
SOCIAL_DEFAULTS = ("1080x1080", "1080x1350")
# Named output ratios of the image service, in order.
NAMED_RATIOS = (
    ("square_1_1", 1.0), ("classic_4_3", 4 / 3), ("traditional_3_4", 3 / 4), ("widescreen_16_9", 16 / 9),
    ("social_story_9_16", 9 / 16), ("smartphone_horizontal_20_9", 20 / 9), ("smartphone_vertical_9_20", 9 / 20),
    ("standard_3_2", 3 / 2), ("portrait_2_3", 2 / 3), ("horizontal_2_1", 2.0), ("vertical_1_2", 0.5),
    ("social_5_4", 5 / 4), ("social_post_4_5", 4 / 5), ("cinematic_21_9", 21 / 9),
)
# Budgets.
MAX_OUTPUT_PIXELS = 16_000_000
MAX_BATCH_PIXELS = 240_000_000
MAX_PIECES = 120
MAX_PRODUCTS_PER_PIECE = 6
MAX_PRODUCT_PIXELS = 50_000_000
MAX_DECODE_PIXELS = 24_000_000
MAX_SOURCE_PIXELS = 80_000_000

# --------------------------------------------------------------- product sizes
# Family, pattern on normalised text, usual height in cm, label.
# The first match wins, so the order is the rule.
PRODUCT_FAMILIES = (
    ("refrigeradora", r"refrigerador\w*|nevera\w*|frigorific\w*|side\s*by\s*side", 170.0, "refrigeradora"),
    ("cocina", r"cocina\w*|estufa\w*", 90.0, "cocina"),
    ("lavadora", r"lavadora\w*|lava\s*seca\w*", 95.0, "lavadora"),
    ("secadora", r"secadora\w*", 95.0, "secadora"),
    ("lavavajillas", r"lavavajillas|lava\s*platos", 85.0, "lavavajillas"),
    ("congelador", r"congelador\w*|freezer\w*", 85.0, "congelador"),
    ("campana", r"campana\w*|extractor\w*\s+de\s+olor\w*", 55.0, "campana extractora"),
    ("calefon", r"calefon\w*|calentador\w*\s+de\s+agua", 60.0, "calefón"),
    ("cilindro_gas", r"cilindro\w*|bombona\w*|tanque\w*\s+de\s+gas", 58.0, "cilindro de gas"),
    ("microondas", r"microonda\w*", 30.0, "microondas"),
    ("horno", r"\bhornos?\b", 60.0, "horno"),
    ("licuadora", r"licuadora\w*", 40.0, "licuadora"),
    ("batidora", r"batidora\w*", 33.0, "batidora"),
    ("arrocera", r"arrocera\w*", 28.0, "olla arrocera"),
    ("freidora", r"freidora\w*|air\s*fry\w*", 35.0, "freidora de aire"),
    ("cafetera", r"cafetera\w*", 33.0, "cafetera"),
    ("hervidor", r"hervidor\w*|jarra\w*\s+electric\w*", 25.0, "hervidor"),
    ("sanduchera", r"sanduchera\w*|wa?fflera\w*|waflera\w*", 12.0, "sanduchera"),
    ("exprimidor", r"exprimidor\w*|extractor\w*\s+de\s+jugo\w*", 40.0, "extractor de jugos"),
    ("ollas", r"juego\w*\s+de\s+ollas|bateria\w*\s+de\s+cocina", 25.0, "juego de ollas"),
    ("plancha", r"\bplanchas?\b(?!\s+de\s+induccion)", 15.0, "plancha"),
    ("aire", r"aire\w*\s+acondicionado|\bsplit\b", 30.0, "aire acondicionado"),
    ("ventilador_pedestal", r"ventilador\w*\s+(?:de\s+)?pedestal", 130.0, "ventilador de pedestal"),
    ("dispensador", r"(?:dispensador|purificador)\w*\s+de\s+agua", 100.0, "dispensador de agua"),
    ("soundbar", r"barra\w*\s+de\s+sonido|sound\s*bar", 9.0, "barra de sonido"),
    ("televisor", r"televisor\w*|smart\s*tv|\btv\b", 70.0, "televisor"),
    ("monitor", r"monitor\w*", 40.0, "monitor"),
    ("parlante", r"parlante\w*|torre\w*\s+de\s+sonido|bafle\w*", 100.0, "parlante"),
    ("consola", r"playstation|\bps[45]\b|xbox|nintendo\s*switch", 30.0, "consola"),
    ("laptop", r"laptop\w*|portatil\w*|notebook\w*", 25.0, "laptop"),
    ("tablet", r"tablet\w*|\bipad\b", 25.0, "tablet"),
    ("celular", r"celular\w*|smartphone\w*|telefono\w*|\biphone\b", 16.0, "celular"),
    ("audifonos", r"audifono\w*|auricular\w*|headphone\w*", 20.0, "audífonos"),
    ("bicicleta", r"bicicleta\w*|\bbici\b", 105.0, "bicicleta"),
)
SCREEN_FAMILIES = ("televisor", "monitor")
WIDTH_FAMILIES = ("cocina",)
INCH_PATTERN = r"(?<!\d)(\d{2})(?!\d)\s*(?:\"|''|pulg\w*|p(?![a-z]))"
MIN_RELATIVE_HEIGHT = 0.30
PROPORTION_TOLERANCE = 0.22

# -------------------------------------------------------------------- quality
# Scoring thresholds.
SAFE_MARGIN = 0.035
MIN_LOGO_WIDTH_RATIO = 0.055
MIN_HEADLINE_FONT_RATIO = 0.022
MIN_LEGAL_FONT_RATIO = 0.008
MIN_TEXT_CONTRAST = 4.5
PRODUCT_COVERAGE = (0.06, 0.68)
FILL_HIGH = 0.95
AIRY_FILL = 0.34
EMPTY_FILL = 0.12
FULL_BLEED = 0.92
DEAD_BAND_EDGE = 0.08
DEAD_BAND_TOTAL = 0.18
FAITHFUL_ASPECT = 0.18
MANDATORY = ("logo", "headline", "subheadline", "price", "cta", "legal")
# Metric -> defect that blocks publication.
BLOCKING = (
    ("product_scale_conflicts", "proporciones irreales entre los productos"),
    ("severe_overlaps", "solapamientos graves"),
    ("outside_canvas", "elementos fuera del lienzo"),
    ("distorted_layers", "capas deformadas"),
    ("empty_composition", "la pieza es casi todo fondo"),
    ("letterbox", "el arte flota en una franja del lienzo"),
)
MAX_ATTEMPTS = 3
RETRY_SEED_STEP = 7919
MIN_SOURCE_COVERAGE = 0.45
MIN_LAYERS_TO_RECOMPOSE = 3
BANNER_ASPECT = 2.4
COLUMN_OVERLAP = 0.25
GROUP_OVERLAP = 0.5
ZONE_CLASH = 0.35
TEXT_PLATE_RATIO = 0.14
MIN_PRODUCT_BAND = 0.18
MIN_SLOT_SIDE = 0.02
MIN_PRODUCT_ZONE = 0.05
GRID_MIN_SIDE = 120
ERASE_FULL_BLEED = 0.85
ERASE_MAX_RATIO = 0.45
PLATE_SAME_PIXELS = 8.0

# ------------------------------------------------------------------- art reads
# Patterns that tell what a line of art copy is.
ART_MONEY = r"(?i)[$€]|\busd\b|\bs/\b"
ART_ONLY_FIGURE = r"^\s*[$S]?\s*\d[\d.,\s]*$"
ART_PERCENT = r"(?i)\d\s*%|\bdto\b|\bdescuento\b|\boff\b"
ART_BEFORE = r"(?i)\bantes\b|\bregular\b|\bde\s*\$|\bprecio\s+normal\b"
ART_INSTALLMENT = r"(?i)\bcuotas?\b|\bal\s*mes\b|\bmensual(?:es)?\b|\bsemanal(?:es)?\b|\bmeses\b|\bdesde\b"
ART_VALIDITY = r"(?i)\bvalid\w*\b|\bvigen\w*\b|\bhasta\s+el\b|\bdel\s+\d|\b\d{1,2}\s*/\s*\d{1,2}\b"
ART_LEGAL = (
    r"(?i)\bt[eé]rminos\b|\bcondiciones\b|\brestricciones\b|\baplican\b|\bconsulte\b"
    r"|\bstock\b|\bsuperintendencia\b|\bruc\b"
)
ART_CTA = (
    r"(?i)\bcompra\b|\bcomprar\b|\bvisita\b|\bvisítanos\b|\bllama\b|\bcot[ií]za\b"
    r"|\bpide\b|\bordena\b|\baprovecha\b|\bcl[ií]c\b|\bm[aá]s\s+info\b"
)
ART_MIN_CONFIDENCE = 0.6
ART_MAX_FIELD = 0.28

# Words and patterns of the line classifier.
LINE_PRICE = (
    r"(?i)(?:^|\s)(?:[$€£¢]|usd|ars|mxn|cop|clp|pen|s/\.?|bs\.?)\s?\d|"
    r"\d+[.,]\d{2}\s?(?:usd|€|\$)?|"
    r"\d+\s?%\s?(?:dcto|desc|off)"
)
LINE_PERCENT = r"\d+\s?%"
LINE_CTA_WORDS = (
    "compra", "comprar", "conoce", "descubre", "click", "clic", "visita", "pide", "pedir", "ordena",
    "reserva", "regístrate", "registrate", "descarga", "suscríbete", "suscribete", "solicita", "llama",
    "escríbenos", "escribenos", "ver más", "ver mas", "más info", "mas info", "shop now", "buy now",
    "learn more", "sign up", "aprovecha", "quiero",
)
LINE_LEGAL_WORDS = (
    "aplican", "términos", "terminos", "condiciones", "restricciones", "válido", "valido", "vigencia",
    "consulta", "promoción válida", "hasta agotar", "stock", "superintendencia", "registro sanitario",
    "imagen referencial", "no incluye", "*", "©", "®",
)

# ------------------------------------------------------------------ layer names
# Category -> words in a layer name; the first category wins.
LAYER_NAME_RULES = (
    ("legal", ("legal", "termino", "condicion", "restriccion", "vigencia")),
    ("price", ("precio", "price", "descuento", "dcto", "off", "%", "hasta")),
    ("cta", ("cta", "boton", "button", "comprar", "compra", "shop")),
    ("headline", ("titular", "headline", "title", "claim")),
    ("subheadline", ("bajada", "subtitulo", "subhead")),
    ("logo", ("logo", "marca", "brand", "isotipo")),
    ("person", ("modelo", "persona", "people", "model")),
    ("product", ("producto", "product", "zapato", "shoe", "ropa", "prenda", "accesorio")),
    ("background", ("fondo", "background", "relleno de color", "bg", "backplate")),
    ("decoration", ("sello", "cece", "adorno", "franja")),
)
SEAL_WORDS = ("cece", "sello", "camara")
GENERIC_LAYER_NAMES = (
    "capa", "layer", "objeto inteligente", "smart object", "grupo", "group",
    "rectangulo", "rectangle", "shape", "elipse", "ellipse", "copia", "copy",
)
# Name tokens that decide whether a layer may be frozen.
ASSET_BACKGROUND_TOKENS = (
    "background", "backdrop", "bg", "fondo", "gradiente", "gradient",
    "textura", "texture", "pattern", "patron", "relleno", "backplate",
)
ASSET_DECORATION_TOKENS = (
    "deco", "decoracion", "decorative", "ornamento", "ornament", "marco", "frame", "trama", "linea",
    "lineas", "line", "forma", "formas", "shape", "shapes", "brillo", "glow", "destello", "spark",
    "estrella", "star", "onda", "wave", "rayo", "ray", "curva", "curve",
)
ASSET_EXCLUDED_TOKENS = (
    "producto", "product", "sku", "modelo", "pack", "combo", "precio", "price", "oferta", "promo",
    "promotion", "discount", "descuento", "cuota", "titulo", "titular", "headline", "texto", "text",
    "legal", "cta", "llamado", "fecha", "date", "vigencia", "validity", "vencimiento", "vence",
    "codigo", "code", "qr", "url", "link", "web", "website", "instagram", "insta", "ig", "facebook",
    "fb", "tiktok", "youtube", "yt", "linkedin", "whatsapp", "twitter", "redes", "social", "icon",
    "icono", "iconos", "emoji", "foto", "photo", "imagen", "image", "persona", "person",
)
ASSET_LOGO_TOKENS = ("logo", "logotipo", "isotipo", "marca", "brand", "wordmark")
ASSET_DUPLICATE_TOKENS = ("copy", "copia", "copie", "kopie", "duplicado")
FIXED_ASSET_ROLES = ("fixed_background", "fixed_decoration")
FIXED_ASSET_LIMIT = 8

# ------------------------------------------------------------------ documents
# Role -> words in file name and text.
DOCUMENT_ROLE_WORDS = (
    ("brand_manual", ("manual de marca", "brand book", "brandbook", "guideline")),
    ("strategy", ("brief", "objetivo", "audiencia", "insight", "concepto", "estrateg")),
    ("key_visual", ("key visual", "keyvisual", " kv ", "arte maestro")),
    ("final_art", ("arte final", "final art", "aprobado")),
    ("logo", ("logo", "logotipo", "isotipo")),
    ("background", ("fondo", "background", "textura")),
    ("legal", ("legal", "terminos", "terminos y condiciones", "restriccion")),
    ("schedule", ("cronograma", "calendario", "vigencia", "fecha de publicacion")),
    ("product_reference", ("producto", "catalogo", "sku", "referencia comercial")),
)
# Accepted file extensions -> kind.
EXTENSION_KINDS = {
    "pdf": "pdf", "ai": "layered_design", "pptx": "presentation", "psd": "layered_design",
    "psb": "layered_design", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image",
    "bmp": "image", "gif": "image", "tif": "image", "tiff": "image", "avif": "image",
}
DROP_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "avif", "psd")
PLATE_ROLE_RANK = {"key_visual": 0, "final_art": 0, "background": 1, "visual_reference": 2}
PLATE_KINDS = ("image", "layered_design", "pdf", "presentation")
TEXT_LIMIT = 60_000
EVIDENCE_LIMIT = 120_000
EXCERPT_BUDGET = 48_000
EXCERPT_PER_SOURCE = 6_000
EXCERPT_MARKER = "\n[…contenido recortado para análisis…]\n"

# Signal patterns over campaign evidence.
SIGNAL_PRICE = (
    r"\bprecio(?:s)?\b", r"\bdescuento(?:s)?\b", r"\bcuota(?:s)?\b", r"\boferta(?:s)?\b",
    r"\bpromoci[oó]n(?:es)?\b", r"\$\s*\d", r"\b\d+\s*%",
)
SIGNAL_COMBO = (
    r"\bcombo(?:s)?\b", r"\bpack(?:s)?\b", r"\bbundle(?:s)?\b", r"\bkit(?:s)?\b",
    r"\b2\s*[x×]\s*1\b", r"\bdos\s+productos\b",
)
SIGNAL_PRODUCT = (
    r"\bproducto(?:s)?\b", r"\bcat[aá]logo\b", r"\bcomprar\b", r"\bvender\b", r"\bventa(?:s)?\b",
    r"\bcr[eé]dito\b",
)
SIGNAL_INSTITUTIONAL = (
    r"\binstitucional\b", r"\bmarca\b", r"\bbranding\b", r"\bcomunidad\b", r"\breputaci[oó]n\b",
    r"\bawareness\b",
)
SIGNAL_LEGAL = (r"\blegal(?:es)?\b", r"\bt[eé]rminos\b", r"\bvigencia\b", r"\brestricciones\b")

# ---------------------------------------------------------------------- web
LOGIN_SIGNALS = (
    "log in", "login", "inicia sesion", "iniciar sesion", "create an account",
    "crea una cuenta", "sign up", "registrate para", "facebook – log in",
)
IMAGE_NOISE = (
    "favicon", "sprite", "logo", "icon", "avatar", "profile_pic",
    "instagram-logo", "facebook-logo", "apple-touch",
)
# Network -> path parts that mark a publication.
POST_PATHS = (
    ("instagram.com", ("p", "reel", "reels", "tv", "stories"), True),
    ("facebook.com", ("posts", "photos", "photo", "reel", "reels", "videos", "video"), False),
    ("fb.com", ("posts", "photos", "photo", "reel", "reels", "videos", "video"), False),
    ("tiktok.com", ("video",), False),
    ("linkedin.com", ("posts", "feed", "video"), False),
)
HANDLE_STOP = ("p", "reel", "reels", "tv", "stories", "explore")
MAX_POSTS = 24
MAX_RANGE_DAYS = 31
DEFAULT_RANGE_DAYS = 30

# ------------------------------------------------------- proposal canonical form
# Names a proposal may use -> canonical names.
CATEGORY_ALIASES = {
    "single": "single_product", "product": "single_product", "single_product": "single_product",
    "product_post": "single_product", "promotion": "price_promotion", "promo": "price_promotion",
    "offer": "price_promotion", "sale": "price_promotion", "price": "price_promotion",
    "price_promotion": "price_promotion", "multi_product": "combo", "multiple_products": "combo",
    "bundle": "combo", "combo": "combo", "benefit": "product_benefit",
    "product_benefit": "product_benefit", "institutional": "institutional",
    "editorial": "institutional", "branding": "institutional",
}
SLOT_KEY_ALIASES = {
    "product": "producto", "product_image": "producto", "main_product": "producto",
    "products": "productos", "product_images": "productos", "product_name": "nombre_producto",
    "name": "nombre_producto", "headline": "titular", "title": "titular", "main_title": "titular",
    "subheadline": "subtitulo", "subtitle": "subtitulo", "description": "subtitulo",
    "price": "precio", "current_price": "precio", "sale_price": "precio",
    "old_price": "precio_anterior", "previous_price": "precio_anterior",
    "original_price": "precio_anterior", "installment": "cuota", "installments": "cuota",
    "discount": "descuento", "saving": "descuento", "call_to_action": "cta", "button": "cta",
    "terms": "legal", "legal_text": "legal", "disclaimer": "legal", "validity": "vigencia",
    "date": "vigencia", "logo_image": "logo", "brand_logo": "logo",
}
SLOT_CATEGORY = {
    "producto": "product", "productos": "product", "nombre_producto": "product_name",
    "titular": "headline", "subtitulo": "subheadline", "precio": "price",
    "precio_anterior": "previous_price", "cuota": "installment", "descuento": "discount",
    "cta": "cta", "legal": "legal", "vigencia": "validity", "logo": "logo",
}
SLOT_KIND = {
    "producto": "image", "productos": "image", "logo": "image", "precio": "money",
    "precio_anterior": "money", "cuota": "money", "descuento": "badge", "vigencia": "date",
}

# -------------------------------------------------------------- layout wishes
# Words in an instruction -> effect on the layout bias.
BIAS_SCALE = (
    ("product_scale", 1.18, ("producto grande", "product big", "hero", "protagonista")),
    ("product_scale", 0.85, ("producto pequeño", "producto pequeno", "product small")),
    ("text_scale", 1.15, ("texto grande", "titular grande", "big headline")),
    ("product_scale", 0.94, ("minimal", "limpio", "aire", "espacio", "respirar")),
)
BIAS_LAYOUTS = (
    (("producto grande", "product big", "hero", "protagonista"), ("hero_product_overlay",)),
    (("texto arriba", "titular arriba", "headline top"),
     ("product_center_headline_top", "headline_center_product_bottom")),
    (("centrado", "centered", "simétrico", "simetrico"), ("product_center_headline_top", "vertical_stack")),
    (("vertical", "apilado", "stack"), ("vertical_stack",)),
    (("diagonal", "dinámico", "dinamico"), ("diagonal_flow",)),
    (("dividido", "split", "dos bloques"), ("split_blocks",)),
    (("izquierda", "left"), ("product_left",)),
    (("derecha", "right"), ("product_right",)),
)
BIAS_CENTER_ALIGN = ("centrado", "centered", "simétrico", "simetrico")
BIAS_HORIZONTAL = (
    ("left", ("izquierda", "left")), ("right", ("derecha", "right")),
    ("center", ("centrado", "centrada", "centro", "centered")),
)
BIAS_VERTICAL = (("top", ("arriba", "superior", "top")), ("bottom", ("abajo", "inferior", "bottom")))
BIAS_AIR = ("minimal", "limpio", "aire", "espacio", "respirar")

# ------------------------------------------------------------------ documents
FRAME_RATIO = (0.10, 0.85)
FRAME_ASPECT = (0.45, 2.3)
PIECE_PRODUCT_RATIO = (0.035, 0.60)
VECTOR_VERSION = 7
PRICE_TEXT = r"(?i)[$€]|\bcuotas?\b|\bsemanal|\bmensual|\bentrada\b"
SPACED_TEXT = r"^(?:\S\s){4,}"
NEAR_DUPLICATE_BITS = 24
NEAR_DUPLICATE_COLOUR = 18
NEAR_DUPLICATE_ASPECT = 0.06
