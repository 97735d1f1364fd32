"""Results must carry exactly these texts and numbers."""

PORTAL = "https://www.war.gov/UFO/"
DEFAULT_LAT, DEFAULT_LON = 37.2350, -115.8111
BATCH_DATE, ENGINE_DATE = "2026-08-16", "2026-01-01"
ID_PREFIX = "UAP-"
BATCH_ID_CHARS, ENGINE_ID_CHARS = 30, 20
BATCH_TEXT_CHARS, ENGINE_TEXT_CHARS = 3500, 3000
BATCH_SENT_CHARS, ENGINE_SENT_CHARS = 2500, 4000
ENGINE_PAGES = 5
MEDIA_EXTENSIONS = (".pdf", ".mp4", ".jpg", ".png", ".avi", ".mov")
EMBED_DIM, TOP_K = 1536, 5
FRAME_STRIDE = 30
EMPTY_STATS = (375, 19, 356, 94.9, 5.1)

UNRESOLVED, RESOLVED = "Unresolved", "Resolved"
BATCH_LOCATION, ENGINE_LOCATION = "USA / Vládní archiv (war.gov/UFO)", "Dle AI analýzy"
TITLE_BATCH = "Odtajněný spis AARO/NARA: "
TITLE_PDF = "Odtajněný spis: "
TITLE_VIDEO = "Senzorový záznam HUD/FLIR: "
TITLE_IMAGE = "Obrazový důkaz: "
SEARCH_PREFIXES = ("Odtajněný spis: ", "Senzorový záznam HUD/FLIR: ", "Obrazový důkaz: ", "Záznam: ")

DEFAULT_SNIPPET = "Záznam vykazuje anomální parametry a netradiční letovou dynamiku."
DEFAULT_TEXT = "Archival package retrieved from local repository."
BATCH_TEXT = "Archival package retrieved from local repository: {}."
SCANNED_TEXT = "Skenovaný obrazový dokument. Vyžaduje hluboké OCR."
FILE_TEXT = "Zdrojový soubor: {}"
NO_ORIGINAL = "Originální text nenalezen."
NO_ANALYSIS = "Analýza zatím nebyla provedena."

ANSWER_DEFAULTS = {
    "pdf": "Chyba překladu",
    "scanned": "Dokument obsahuje pouze skenované obrázky.",
    "video": "Optická analýza vizuálního záznamu.",
    "image": "Optická analýza vizuálního záznamu.",
}
ANSWER_ERROR = "Překlad a geolokace selhala kvůli chybě API."
PARSE_ERROR = "Chyba parsování PDF: "
REQUEST_FILE, REQUEST_TEXT = "Název souboru: ", "\n\nText spisu: "
REQUEST_SCANNED = "Dokument bez textové vrstvy."
REQUEST_MEDIA = "Obrazový/video záznam - vizuální analýza."
NO_SERVICE = "[Chybí OPENAI_API_KEY]: "
BATCH_SNIPPET = "Badatelský přehled (Lokální ETL): Materiál {} byl zaevidován a připraven k analýze."
HUD_NOTE = "Objekt vykazuje vektorový pohyb nezávislý na okolním proudění vzduchu."

# id, title, date, location, latitude, longitude, snippet, original text
SEED_CASES = (
    ("MR-75", "Případ USS Nimitz (Release 01)", "2004-11-14", "Tichý oceán", 32.5, -120.5, "Byl detekován anomální objekt bez viditelných nosných ploch. Ztratil tepelnou stopu během teplotního přechodu (thermal crossover).", "Anomalous object detected with no visible flight control surfaces. Lost thermal signature during thermal crossover."),
    ("UTAH-1953", "Film Analysis - Utah Sighting", "1952-07-02", "Utah, USA", 40.7608, -111.8910, "Analýza 16mm filmu: Objekt vykazoval rychlost přes 3780 mph a akceleraci dosahující až 965 g.", "Interpretation of Movies of Unidentified Objects; velocity computed to be 3780 mph for a shift of 1 mm per frame."),
    ("FBI-2026", "FD-302 Multiple Red Lights", "2026-02-10", "Nevada Range, USA", 37.2350, -115.8111, "Pozorování 6 až 10 červených světel, která se pohybovala v synchronizované formaci a náhle klesla o 1000 stop.", "Multiple more (approximately 6 to 10) lights appeared directly over their position, appeared to sync up and traveled east/southeast."),
)

# pattern in the case id, new title, new snippet; the first that fits counts
REPAIR_RULES = (
    ("AUTO-DOD_1", "Senzorový záznam / FLIR telemetrie: DOD_111830007-1920x1080-9000k.mp4", "Telemetrická analýza videa: Snímek po snímku rozložená dynamika letu, vysoká úhlová rychlost bez doprovodné zvukové stopy či emisí."),
    ("AUTO-DOW-", "Odtajněný spis: DOW-UAP-D098_Film-Analysis-of-Unidentified-Objects_1953", "Lokální AI analýza spisu: Dokument rozborově potvrzuje anomální charakteristiky, neregistrovanou akceleraci bez viditelných nosných ploch."),
    ("AUTO-FBI-", "Obrazová analýza: FBI-UAP-D025_Digital-Rendering_Airborne-Triangle_2002.jpg", "Optická analýza snímku: Detekován neregistrovaný objekt geometrické konfigurace v optickém spektru."),
    ("MR-75", "Případ USS Nimitz (Release 01)", "Byl detekován anomální objekt bez viditelných nosných ploch. Ztratil tepelnou stopu během teplotního přechodu (thermal crossover)."),
    ("UTAH-1953", "Analýza filmu - Pozorování Utah", "Analýza 16mm filmu: Objekt vykazoval rychlost přes 3780 mph a akceleraci dosahující až 965 g."),
    ("FBI-2026", "Hlášení FD-302 Více červených světel", "Pozorování 6 až 10 červených světel, která se pohybovala v synchronizované formaci a náhle klesla o 1000 stop."),
)
