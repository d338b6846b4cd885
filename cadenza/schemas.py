"""Explicit schemas; nothing is inferred."""

FILES = "path string, parent string, stem string, ext string, length bigint, modified timestamp"
TRACKS = (
    "path string, parent string, artist string, title string, album string, album_artist string, track_number int, disc_number int, date string, genre string, isrc string, "
    "bpm double, track_gain double, track_peak double, lyrics string, synced_lyrics string, mbid string, album_mbid string, fingerprint string, sample_rate int, bitrate int, channels int, bits int, "
    "is_lossless boolean, has_album_gain boolean, checksum_ok boolean, hf_rms double, read_error string"
)
LYRICS = "parent string, stem string, text string"
RELEASES = "artist_key string, pos int, id string, title string, date string"
RECORDINGS = "artist_key string, title_key string, pos int, id string"
FINGERPRINTS = "fingerprint string, results array<struct<score:double,recording_id:string,title:string,artist:string>>"
TAGS = "mbid string, artist_key string, title_key string, names array<string>"
MARKET = "artist_key string, album_key string, pos int, id bigint, title string, year int, genres array<string>"
ARTWORK = "artist_key string, album_key string, results array<struct<artworkUrl100:string>>"
FOUND_LYRICS = "artist_key string, title_key string, text string"
RELEASE_SEARCH = "artist_key string, album_key string, pos int, id string, title string, date string"
STORIES = "artist_key string, title_key string, plain string"
CACHE = "key string, value_json string, stored_at timestamp, expires_at timestamp"
ACTIONS = "src string, dst string, kind string, status string"
