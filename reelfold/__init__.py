"""reelfold: a media-catalogue event engine expressed as PySpark DataFrame operators."""
