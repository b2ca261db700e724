"""pagelake: web-document analytics as DataFrame-to-DataFrame functions on Spark."""
