"""Names, lists and texts that results must equal."""

# file name extensions by kind of file
PHOTO = (".jpg", ".jpeg", ".png", ".tif", ".tiff")
HEIC = (".heic", ".heif")
GIF = (".gif",)
WEBP = (".webp",)
MP4 = (".mp4",)
VIDEO = (
    ".mov", ".mkv", ".avi", ".wmv", ".flv", ".m4v", ".webm", ".mpg", ".mpeg", ".3gp", ".mts", ".m2ts", ".ts", ".mxf", ".qt", ".asf", ".dvr-ms",
    ".wtv", ".rm", ".rmvb", ".f4v", ".ogv", ".ogm", ".vob", ".vro", ".mod", ".tod", ".dv", ".3g2", ".m1v", ".m2v", ".m2p", ".mpv", ".divx", ".xvid",
)
BUNDLE = (
    ".photoslibrary", ".aplibrary", ".migratedphotolibrary", ".photolibrary", ".app", ".fcpbundle", ".imovielibrary", ".tvlibrary", ".theater",
)
SIDECAR = (".aae", ".xmp")

#: folders that hold an original while it is replaced
TRANSACTION = ".replacing-"
KINDS = {"photo": PHOTO, "heic": HEIC, "gif": GIF, "webp": WEBP, "video": VIDEO, "mp4": MP4}

# words that stay in lower case inside a title
SMALL_WORDS = (
    "a", "an", "and", "as", "at", "but", "by", "de", "del", "der", "di", "for", "in", "la", "le", "nor", "of", "on", "or", "the", "to", "van", "von",
    "with",
)
# endings of site names
SITE_ENDS = (
    "com", "net", "org", "io", "co", "tv", "me", "cc", "xyz", "info", "biz", "site", "online", "club",
)
CAMERA_PREFIXES = (
    "IMG", "DSC", "DSCN", "DSCF", "MVI", "VID", "PXL", "GOPR", "PANO", "DJI",
)

# stream metadata
COLOR_FIELDS = ("color_range", "color_space", "color_transfer", "color_primaries", "chroma_location")
COLOR_OPTIONS = {"color_range": "color_range", "color_space": "colorspace", "color_transfer": "color_trc", "color_primaries": "color_primaries", "chroma_location": "chroma_sample_location"}
HDR_MARKERS = ("mastering display", "content light", "dolby vision", "dovi", "hdr10", "smpte 2094-50", "hdr vivid")
TEXT_SUBTITLES = ("mov_text", "subrip", "srt", "text", "webvtt")
COVER_CODECS = ("mjpeg", "png")
COVER_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp", ".tif", ".tiff")
H264_FORMATS = ("yuv420p", "yuvj420p")
HEVC_FORMATS = ("yuv420p", "yuv420p10le")
IDENTITY_TAGS = ("language", "title", "name", "handler_name", "filename", "mimetype")
DISPOSITIONS = ("default", "dub", "original", "comment", "lyrics", "karaoke", "forced", "hearing_impaired", "visual_impaired", "captions", "descriptions", "metadata", "dependent", "still_image")
COMPARED_DISPOSITIONS = ("dub", "original", "forced", "hearing_impaired", "visual_impaired", "descriptions")
GENERIC_AUDIO_HANDLERS = ("soundhandler", "audiohandler", "audiomediahandler", "soundmediahandler", "coremediaaudio")
GENERIC_TEXT_HANDLERS = ("subtitlehandler", "texthandler", "subtitlemediahandler")
ALPHA_PREFIXES = ("rgba", "argb", "bgra", "abgr", "yuva", "gbrap")
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")
TRUNCATION_MARKERS = ("File ended prematurely", "Input file is truncated", "input file is truncated")
PHOTO_DECODE_MARKERS = ("Cannot read input picture file", "Could not process file", "`jpegtran -copy all` MAY be able to process this file")
STATUSES = ("converted", "remuxed", "repaired", "skipped", "failed", "planned")
