"""Readers and writers for labelled tables, annotations, file trees and results."""
