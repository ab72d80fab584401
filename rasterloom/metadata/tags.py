"""Names of EXIF tags, as rows and by lookup."""

from __future__ import annotations

from dataclasses import dataclass

# Number, name and bytes of each value type.
TYPES = {1: ("BYTE", 1), 2: ("ASCII", 1), 3: ("SHORT", 2), 4: ("LONG", 4), 5: ("RATIONAL", 8), 6: ("SBYTE", 1), 7: ("UNDEFINED", 1), 8: ("SSHORT", 2), 9: ("SLONG", 4), 10: ("SRATIONAL", 8), 11: ("FLOAT", 4), 12: ("DOUBLE", 8), 13: ("IFD", 4), 129: ("UTF-8", 1)}
NUMBER = {name: number for number, (name, _) in TYPES.items()}
# Tag, name, type that writers use, and number of values where it is fixed.
IFD0 = """
0100 ImageWidth LONG 1
0101 ImageLength LONG 1
0102 BitsPerSample SHORT
0103 Compression SHORT 1
0106 PhotometricInterpretation SHORT 1
010d DocumentName ASCII
010e ImageDescription ASCII
010f Make ASCII
0110 Model ASCII
0111 StripOffsets LONG
0112 Orientation SHORT 1
0115 SamplesPerPixel SHORT 1
0116 RowsPerStrip LONG 1
0117 StripByteCounts LONG
011a XResolution RATIONAL 1
011b YResolution RATIONAL 1
011c PlanarConfiguration SHORT 1
0128 ResolutionUnit SHORT 1
012d TransferFunction SHORT
0131 Software ASCII
0132 DateTime ASCII
013b Artist ASCII
013c HostComputer ASCII
013e WhitePoint RATIONAL 2
013f PrimaryChromaticities RATIONAL 6
0144 TileOffsets LONG
0145 TileByteCounts LONG
014a SubIFDs LONG
0201 JPEGInterchangeFormat LONG 1
0202 JPEGInterchangeFormatLength LONG 1
0211 YCbCrCoefficients RATIONAL 3
0212 YCbCrSubSampling SHORT 2
0213 YCbCrPositioning SHORT 1
0214 ReferenceBlackWhite RATIONAL 6
02bc ApplicationNotes BYTE
4746 Rating SHORT 1
4749 RatingPercent SHORT 1
8298 Copyright ASCII
83bb IPTC-NAA LONG
8769 ExifIFDPointer LONG 1
8773 InterColorProfile UNDEFINED
8825 GPSInfoIFDPointer LONG 1
9c9b XPTitle BYTE
9c9c XPComment BYTE
9c9d XPAuthor BYTE
9c9e XPKeywords BYTE
9c9f XPSubject BYTE
c4a5 PrintImageMatching UNDEFINED
c612 DNGVersion BYTE 4
c614 UniqueCameraModel ASCII
c62f CameraSerialNumber ASCII
c634 DNGPrivateData BYTE
ea1c Padding UNDEFINED
ea1d OffsetSchema SLONG 1
"""
EXIF = """
829a ExposureTime RATIONAL 1
829d FNumber RATIONAL 1
8822 ExposureProgram SHORT 1
8824 SpectralSensitivity ASCII
8827 ISOSpeedRatings SHORT
8828 OECF UNDEFINED
8830 SensitivityType SHORT 1
8831 StandardOutputSensitivity LONG 1
8832 RecommendedExposureIndex LONG 1
8833 ISOSpeed LONG 1
9000 ExifVersion UNDEFINED 4
9003 DateTimeOriginal ASCII 20
9004 DateTimeDigitized ASCII 20
9010 OffsetTime ASCII
9011 OffsetTimeOriginal ASCII
9012 OffsetTimeDigitized ASCII
9101 ComponentsConfiguration UNDEFINED 4
9102 CompressedBitsPerPixel RATIONAL 1
9201 ShutterSpeedValue SRATIONAL 1
9202 ApertureValue RATIONAL 1
9203 BrightnessValue SRATIONAL 1
9204 ExposureBiasValue SRATIONAL 1
9205 MaxApertureValue RATIONAL 1
9206 SubjectDistance RATIONAL 1
9207 MeteringMode SHORT 1
9208 LightSource SHORT 1
9209 Flash SHORT 1
920a FocalLength RATIONAL 1
9214 SubjectArea SHORT
927c MakerNote UNDEFINED
9286 UserComment UNDEFINED
9290 SubSecTime ASCII
9291 SubSecTimeOriginal ASCII
9292 SubSecTimeDigitized ASCII
9400 Temperature SRATIONAL 1
9401 Humidity RATIONAL 1
9402 Pressure RATIONAL 1
9403 WaterDepth SRATIONAL 1
9404 Acceleration RATIONAL 1
9405 CameraElevationAngle SRATIONAL 1
a000 FlashpixVersion UNDEFINED 4
a001 ColorSpace SHORT 1
a002 PixelXDimension LONG 1
a003 PixelYDimension LONG 1
a004 RelatedSoundFile ASCII 13
a005 InteropIFDPointer LONG 1
a20b FlashEnergy RATIONAL 1
a20e FocalPlaneXResolution RATIONAL 1
a20f FocalPlaneYResolution RATIONAL 1
a210 FocalPlaneResolutionUnit SHORT 1
a214 SubjectLocation SHORT 2
a215 ExposureIndex RATIONAL 1
a217 SensingMethod SHORT 1
a300 FileSource UNDEFINED 1
a301 SceneType UNDEFINED 1
a302 CFAPattern UNDEFINED
a401 CustomRendered SHORT 1
a402 ExposureMode SHORT 1
a403 WhiteBalance SHORT 1
a404 DigitalZoomRatio RATIONAL 1
a405 FocalLengthIn35mmFilm SHORT 1
a406 SceneCaptureType SHORT 1
a407 GainControl SHORT 1
a408 Contrast SHORT 1
a409 Saturation SHORT 1
a40a Sharpness SHORT 1
a40b DeviceSettingDescription UNDEFINED
a40c SubjectDistanceRange SHORT 1
a420 ImageUniqueID ASCII 33
a430 CameraOwnerName ASCII
a431 BodySerialNumber ASCII
a432 LensSpecification RATIONAL 4
a433 LensMake ASCII
a434 LensModel ASCII
a435 LensSerialNumber ASCII
a436 ImageTitle ASCII
a437 Photographer ASCII
a438 ImageEditor ASCII
a439 CameraFirmware ASCII
a43a RAWDevelopingSoftware ASCII
a43b ImageEditingSoftware ASCII
a43c MetadataEditingSoftware ASCII
a460 CompositeImage SHORT 1
a461 SourceImageNumberOfCompositeImage SHORT 2
a462 SourceExposureTimesOfCompositeImage UNDEFINED
a500 Gamma RATIONAL 1
"""
GPS = """
0000 GPSVersionID BYTE 4
0001 GPSLatitudeRef ASCII 2
0002 GPSLatitude RATIONAL 3
0003 GPSLongitudeRef ASCII 2
0004 GPSLongitude RATIONAL 3
0005 GPSAltitudeRef BYTE 1
0006 GPSAltitude RATIONAL 1
0007 GPSTimeStamp RATIONAL 3
0008 GPSSatellites ASCII
0009 GPSStatus ASCII 2
000a GPSMeasureMode ASCII 2
000b GPSDOP RATIONAL 1
000c GPSSpeedRef ASCII 2
000d GPSSpeed RATIONAL 1
000e GPSTrackRef ASCII 2
000f GPSTrack RATIONAL 1
0010 GPSImgDirectionRef ASCII 2
0011 GPSImgDirection RATIONAL 1
0012 GPSMapDatum ASCII
0013 GPSDestLatitudeRef ASCII 2
0014 GPSDestLatitude RATIONAL 3
0015 GPSDestLongitudeRef ASCII 2
0016 GPSDestLongitude RATIONAL 3
0017 GPSDestBearingRef ASCII 2
0018 GPSDestBearing RATIONAL 1
0019 GPSDestDistanceRef ASCII 2
001a GPSDestDistance RATIONAL 1
001b GPSProcessingMethod UNDEFINED
001c GPSAreaInformation UNDEFINED
001d GPSDateStamp ASCII 11
001e GPSDifferential SHORT 1
001f GPSHPositioningError RATIONAL 1
"""
INTEROP = """
0001 InteropIndex ASCII
0002 InteropVersion UNDEFINED 4
1000 RelatedImageFileFormat ASCII
1001 RelatedImageWidth LONG 1
1002 RelatedImageLength LONG 1
"""
IFDS = ("IFD0", "Exif", "GPS", "Interop", "IFD1")


@dataclass(frozen=True)
class Tag:
    ifd: str
    tag: int
    name: str
    type: str
    count: int | None = None


def listed(ifd: str, lines: str) -> list[Tag]:
    rows = [line.split() for line in lines.split("\n") if line]
    return [Tag(ifd, int(r[0], 16), r[1], r[2], int(r[3]) if len(r) > 3 else None) for r in rows]


#: All tags that have a name, as rows.
TAGS = [t for ifd, lines in (("IFD0", IFD0), ("Exif", EXIF), ("GPS", GPS), ("Interop", INTEROP)) for t in listed(ifd, lines)]
BY_TAG = {(t.ifd, t.tag): t for t in TAGS}
BY_NAME = {t.name.lower(): t for t in TAGS}


def tag_info(ifd: str, tag: int) -> Tag | None:
    """The thumbnail's directory and sub-directories have the names of the first one."""
    return BY_TAG.get((ifd if ifd in ("Exif", "GPS", "Interop") else "IFD0", tag))


def tag_name(ifd: str, tag: int) -> str:
    found = tag_info(ifd, tag)
    return found.name if found else f"0x{tag:04x}"


def tag_by_name(name: str) -> Tag | None:
    return BY_NAME.get(str(name).lower())
