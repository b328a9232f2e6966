"""Fixed values the results depend on."""

# File category -> extensions. Where an extension is listed twice the later category holds it.
CATEGORY_EXTENSIONS = {
    "Images": ".jpg .jpeg .png .gif .bmp .svg .webp .tiff .tif .heic .raw .cr2 .nef",
    "Videos": ".mp4 .avi .mkv .mov .wmv .flv .webm .m4v .3gp .ts .m2ts",
    "Audio": ".mp3 .wav .flac .aac .ogg .m4a .wma .opus .aiff",
    "Documents": ".pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods .txt .rtf .md .csv .epub",
    "Archives": ".zip .rar .7z .tar .gz .bz2 .xz .iso .dmg",
    "Code": ".py .js .ts .jsx .tsx .html .css .java .cpp .c .h .cs .go .rs .rb .php .swift .kt .sql .sh "
            ".bat .ps1 .json .yaml .yml .toml .xml .ini .cfg .env",
    "Executables": ".exe .msi .apk .app .deb .rpm",
    "Fonts": ".ttf .otf .woff .woff2 .eot",
    "3D": ".obj .fbx .blend .stl .dae .glb .gltf",
}
DEFAULT_CATEGORY = "Others"

# Directories that are never listed nor touched.
PROTECTED_UNIX = "/bin /sbin /usr/bin /usr/sbin /etc /lib /lib64 /proc /sys /dev /run /boot /root".split()
PROTECTED_WINDOWS = [
    "C:\\Windows",
    "C:\\Program Files",
    "C:\\Program Files (x86)",
    "C:\\ProgramData",
    "C:\\System Volume Information",
    "C:\\$Recycle.Bin",
    "C:\\Recovery",
    "C:\\Boot",
]

# Confidence of a rule hit, of the extension table, of the fallback.
RULE_CONFIDENCE, TABLE_CONFIDENCE, FALLBACK_CONFIDENCE = 1.0, 0.95, 0.5

# Limits and sizes.
MAX_COLLISIONS = 999          # numbered names tried after the plain one
MIN_HASH_BYTES = 1024         # smaller files take no part in duplicate detection
HEAD_BYTES = 65_536           # bytes hashed in the head stage
READ_CHUNK_BYTES = 8 * 1024 * 1024
DEBOUNCE_SECONDS = 2.0
PAGE_SIZE = 50
MAX_PAGE_LIMIT = 1000

# Error texts of failed moves.
ERROR_NO_SOURCE = "Source file not found"
ERROR_COLLISIONS = "Could not resolve collision after 999 attempts: "


def category_by_extension() -> dict[str, str]:
    """Extension to category; a later category wins a shared extension (``.ts`` is Code)."""
    return {ext: cat for cat, exts in CATEGORY_EXTENSIONS.items() for ext in exts.split()}
