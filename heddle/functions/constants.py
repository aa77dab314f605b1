"""Results depend on each of these as they are."""

#: Extensions of files that count as binary.
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".bmp", ".svg", ".pdf", ".zip", ".tar", ".gz", ".rar", ".7z", ".exe", ".dll", ".so", ".dylib",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".woff", ".woff2", ".ttf", ".eot", ".webp", ".tiff", ".tif", ".psd", ".ai", ".eps", ".doc",
    ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt", ".ods", ".odp", ".flv", ".mkv", ".webm", ".m4v", ".3gp", ".wav", ".flac", ".aac",
    ".ogg", ".m4a", ".otf", ".fon", ".deb", ".rpm", ".msi", ".dmg", ".pkg", ".iso", ".img", ".bin", ".dat", ".db", ".sqlite", ".sqlite3",
    ".mdb",
)

#: Extensions of files that are ignored; those that count as binary or that no file name can end a last dot with are left out.
IGNORED_EXTENSIONS = (
    ".snap", ".pyc", ".class", ".jar", ".war", ".snapshot", ".o", ".obj", ".lib", ".a", ".tsbuildinfo", ".tgz", ".cab", ".msm", ".msp",
    ".log", ".out", ".err", ".tmp", ".temp", ".bak", ".backup", ".orig", ".swp", ".swo", ".apk", ".ipa", ".aab", ".dex", ".key", ".pem",
    ".crt", ".p12", ".pfx",
)

#: A path that contains one of these is ignored. Needles that contain another one are left out.
IGNORED_NEEDLES = (
    "package-lock.json", "pnpm-lock.yaml", "deno-lock", "go.sum", ".lock", ".snap", "__snapshots__/", ".min.js", ".min.css", ".bundle.js",
    ".bundle.css", "dist/", "build/", "coverage/", "target/", "bin/", "obj/", "out/", ".gradle/", ".generated.", "auto-generated",
    "_generated", ".next/", ".nuxt/", ".svelte-kit/", "node_modules/", ".vscode/", ".idea/", ".vs/", ".swp", ".swo", ".ds_store",
    "thumbs.db", ".git/", ".svn/", ".hg/", ".pyc", ".class", ".jar", ".war", "vendor/", ".autobumper", "translations/", ".kotlin/",
    ".pb.go", ".pyo", ".pyd", "__pycache__/", ".Python", "downloads/", "eggs/", "lib/", "lib64/", "parts/", "var/", "wheels/",
    ".installed.cfg", ".egg", "env/", "ENV/", ".log", "local_settings.py", "db.sqlite3", "media/", "staticfiles/", "static/", "migrations/",
    "instance/", ".webassets-cache", ".pytest_cache/", ".coverage", "htmlcov/", ".tox/", ".mypy_cache/", "dmypy.json",
    "celerybeat-schedule", ".nyc_output/", "junit.xml", "test-results/", ".jest/", "karma.conf.js", ".cache/", ".parcel-cache/",
    ".rts2_cache_cjs/", ".rts2_cache_es/", ".rts2_cache_umd/", ".npm/", ".yarn/", ".pnp.", "logs/", "pids/", ".pid", ".seed",
    ".tsbuildinfo", ".tscache/", ".eslintcache", ".stylelintcache", ".tmp", ".temp", "~", ".bak", ".backup", ".orig", ".tar.", ".tgz",
    "hs_err_pid", "replay_pid", "[Dd]ebug/", "[Rr]elease/", "x64/", "x86/", ".user", ".suo", ".sln.docstates", ".bundle/", "doc/",
    ".sass-cache/", "composer.phar", ".test", ".prof", "DerivedData/", ".hmap", ".ipa", ".xcworkspace", ".apk", ".ap_", ".aab", ".dex",
    "captures/", "fastlane/report.xml", "fastlane/Preview.html", "fastlane/screenshots", "fastlane/test_output", ".h5", ".hdf5", ".model",
    ".pkl", ".pickle", "checkpoints/", "tensorboard/", ".terraform/", ".tfstate", ".dockerignore", ".DS_Store", "._", ".Spotlight-V100",
    ".Trashes", "Thumbs.db", "Desktop.ini", "$RECYCLE.BIN/", ".env.", ".envrc", "secrets/", ".key", ".pem", ".crt", ".csr", ".p12", ".pfx",
    "profiler/", "flame-graph.html", "migrate/", "migration/", "schema/", "db/schema.rb", "flyway/", "liquibase/", "seeds/", "fixtures/",
    ".migration.", "_migration.", ".migrate.", "_migrate.", ".schema.", "_schema.",
)

#: Titles by place, in tiers that begin at TIERS.
TITLES = (
    "legend", "line breaker", "conqueror", "destroyer", "warlord", "war chief", "battle lord", "chieftain", "champion", "crusader", "hero",
    "knight", "vanquisher", "slayer", "berserker", "gladiator", "warrior", "blade master", "swordsman", "reaver", "marauder", "raider",
    "mercenary", "fighter", "barbarian", "savage", "code slayer", "git warrior", "commit crusher", "line conqueror", "blacksmith",
    "merchant", "scribe", "weaver", "fisherman", "shepherd", "tavern keeper", "peddler", "potter", "baker", "cooper", "tanner", "cobbler",
    "woodcutter", "mine worker", "dock worker", "field hand", "stable boy", "kitchen wench", "peasant",
)
TIERS = (0, 12, 38)
UNKNOWN_TITLE, FALLBACK_TITLE = "unknown", "peasant"
THRESHOLD_KB = 50
